"""Ordered scans over keyed series: fills, lags, running counts and whole-series values.

A plain window puts all rows of one key into one task, so one long recording stalls the job. Here every series is
cut into chunks of its order axis (by default a time span). Rows are windowed inside ``(key, chunk)``; one small row
per chunk carries what the later or earlier chunks need. The rows are shuffled once, on ``(key, chunk)``, packed so that the
windows and the chunk table read the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_CHUNK = 600_000  # ten minutes on a millisecond axis
_LAST_CHUNK = 9223372036854775807


@dataclass(frozen=True)
class Item:
    """One requested column of a scan."""
    partial: Callable[[Column], Column]   # order key -> aggregate over one chunk
    carry: Callable                       # (chunk frames, partial) -> what a chunk learns from the other chunks
    value: Callable | None                # (row frames, carry) -> result per row; None: the carry is the result
    by_order: bool = True                 # does the partial use the order key?


@dataclass
class _Frames:
    keys: list[str]
    forward: list[Column]
    backward: list[Column]

    @property
    def before(self):
        return W.partitionBy(*self.keys).orderBy(*self.forward).rowsBetween(W.unboundedPreceding, -1)

    @property
    def upto(self):
        return W.partitionBy(*self.keys).orderBy(*self.forward).rowsBetween(W.unboundedPreceding, 0)

    @property
    def after(self):
        return W.partitionBy(*self.keys).orderBy(*self.backward).rowsBetween(W.unboundedPreceding, -1)

    @property
    def onwards(self):
        return W.partitionBy(*self.keys).orderBy(*self.backward).rowsBetween(W.unboundedPreceding, 0)

    @property
    def ordered(self):
        return W.partitionBy(*self.keys).orderBy(*self.forward)

    @property
    def whole(self):
        return W.partitionBy(*self.keys)


def last(value: Column) -> Item:
    """Last non-null value at or before the row (forward fill)."""
    return Item(lambda key: F.max_by(value, F.when(value.isNotNull(), key)),
                lambda w, p: F.last(p, True).over(w.before),
                lambda w, c: F.coalesce(F.last(value, True).over(w.upto), c))


def last_before(value: Column) -> Item:
    """Last non-null value before the row."""
    return Item(lambda key: F.max_by(value, F.when(value.isNotNull(), key)),
                lambda w, p: F.last(p, True).over(w.before),
                lambda w, c: F.coalesce(F.last(value, True).over(w.before), c))


def following(value: Column) -> Item:
    """First non-null value at or after the row (backward fill)."""
    return Item(lambda key: F.min_by(value, F.when(value.isNotNull(), key)),
                lambda w, p: F.last(p, True).over(w.after),
                lambda w, c: F.coalesce(F.last(value, True).over(w.onwards), c))


def previous(value: Column) -> Item:
    """Value of the row before (lag 1), null when that value is null."""
    boxed = F.struct(value.alias("v"))
    return Item(lambda key: F.max_by(boxed, key),
                lambda w, p: F.lag(p).over(w.ordered),
                lambda w, c: F.coalesce(F.lag(boxed).over(w.ordered), c)["v"])


def sum_before(value: Column) -> Item:
    """Sum of ``value`` over the rows before this one, 0 for the first row."""
    return Item(lambda key: F.sum(value),
                lambda w, p: F.coalesce(F.sum(p).over(w.before), F.lit(0)),
                lambda w, c: F.coalesce(F.sum(value).over(w.before), F.lit(0)) + c, by_order=False)


def running_max(value: Column) -> Item:
    """Largest value at or before the row."""
    return Item(lambda key: F.max(value),
                lambda w, p: F.max(p).over(w.before),
                lambda w, c: F.greatest(F.max(value).over(w.upto), c), by_order=False)


def total(fn: Callable[[Column], Column], value: Column) -> Item:
    """``fn`` (min, max or sum) of the whole series on every row."""
    return Item(lambda key: fn(value), lambda w, p: fn(p).over(w.whole), None, by_order=False)


def first_of_all(value: Column) -> Item:
    """First non-null value of the whole series on every row."""
    return Item(lambda key: F.min(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))),
                lambda w, p: F.min(p).over(w.whole)["v"], None)


def last_of_all(value: Column) -> Item:
    """Last non-null value of the whole series on every row."""
    return Item(lambda key: F.max(F.when(value.isNotNull(), F.struct(key.alias("k"), value.alias("v")))),
                lambda w, p: F.max(p).over(w.whole)["v"], None)


@dataclass(frozen=True)
class Segments:
    """Aggregates over the stretch of rows around each row that ends with a row where ``ends`` holds, as columns.

    A value is ``F.min`` or ``F.max`` and what it is taken of. A stretch may cross chunks: inside a chunk it is a window, the
    pieces before the first end and behind the last one are handed on from chunk to chunk until an end.
    """
    ends: Column
    values: dict[str, tuple[Callable[[Column], Column], Column]]

    def number(self, rows: DataFrame, keys: list[str], forward: list[Column]) -> DataFrame:
        """``_scan_seg``: ends before the row in its chunk; ``_scan_left``: ends from the row on."""
        w, end = _Frames(keys, forward, []), F.coalesce(self.ends, F.lit(False)).cast("int")
        before = F.coalesce(F.sum(end).over(w.before), F.lit(0))
        return rows.withColumns({"_scan_end": end, "_scan_seg": before, "_scan_left": F.sum(end).over(w.whole) - before})

    def partials(self) -> dict[str, Column]:
        return {"_ended": F.max("_scan_end")} | {f"_head_{n}": fn(F.when(F.col("_scan_seg") == 0, v)) for n, (fn, v) in self.values.items()} | {
            f"_tail_{n}": fn(F.when(F.col("_scan_left") == 0, v)) for n, (fn, v) in self.values.items()}

    def carried(self, chunks: DataFrame, by: list[str]) -> DataFrame:
        """What the pieces of the chunks before and after have, back to the last end and on to the next one."""
        up, down = (W.partitionBy(*by).orderBy(o) for o in (F.col("_scan_chunk").asc(), F.col("_scan_chunk").desc()))
        chunks = chunks.withColumns({"_past": F.sum("_ended").over(up), "_coming": F.sum("_ended").over(down)})
        ahead = W.partitionBy(*by, "_past").orderBy(F.col("_scan_chunk").asc())
        back = W.partitionBy(*by, "_coming").orderBy(F.col("_scan_chunk").desc())
        chunks = chunks.withColumns({f"_tail_{n}": fn(F.col(f"_tail_{n}")).over(ahead) for n, (fn, _) in self.values.items()} | {
            f"_head_{n}": fn(F.col(f"_head_{n}")).over(back) for n, (fn, _) in self.values.items()})
        return chunks.withColumns({f"_in_{n}": F.lag(f"_tail_{n}").over(up) for n in self.values} | {
            f"_out_{n}": F.lag(f"_head_{n}").over(down) for n in self.values})

    def columns(self, keys: list[str]) -> dict[str, Column]:
        piece = W.partitionBy(*keys, "_scan_seg")
        return {n: (F.least if fn is F.min else F.greatest)(
            fn(v).over(piece), F.when(F.col("_scan_seg") == 0, F.col(f"_in_{n}")), F.when(F.col("_scan_left") == 0, F.col(f"_out_{n}")))
            for n, (fn, v) in self.values.items()}


def order_key(axis: str, ties: Sequence[str]) -> Column:
    """Sortable struct of the row order: axis with nulls last, then the tie columns."""
    return F.struct(F.col(axis).isNull().alias("n"), F.col(axis).alias("a"), *[F.col(t) for t in ties])


def time_chunk(axis: str, width: int = DEFAULT_CHUNK) -> Column:
    return F.coalesce(F.floor(F.col(axis) / F.lit(width)), F.lit(_LAST_CHUNK))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by a hash of the keys, in as many partitions as the session shuffles into.

    The number is named, so that it stays: partitions put together by their compressed size are many times as wide in memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan(df: DataFrame, by: Sequence[str], axis: str, ties: Sequence[str], items: dict[str, Item],
         chunk: Column | None = None, width: int = DEFAULT_CHUNK, segments: Segments | None = None) -> DataFrame:
    """Add one column per item to ``df``; rows of a series are ordered by ``axis`` (nulls last), then ``ties``.

    ``chunk`` must not decrease along that order. A NULL in ``by`` is a value of its own. ``segments`` adds aggregates over
    stretches of rows.
    """
    by, ties, keys = list(by), list(ties), ["_scan_hash", "_scan_at"]
    key = order_key(axis, ties)
    at = F.struct(*[F.col(b) for b in by], (time_chunk(axis, width) if chunk is None else chunk).alias("_chunk"))
    # Windows and chunk table need the same single column of the shuffle, so it is made once; the hash sorts fast.
    packed = df.select(F.xxhash64(at).alias("_scan_hash"), at.alias("_scan_at"), F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("_scan_rows"))
    spread = dealt(packed, *keys).select(*keys, F.inline("_scan_rows"))
    forward = [F.col(axis).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]
    backward = [F.col(axis).desc_nulls_first(), *[F.col(t).desc_nulls_first() for t in ties]]
    partials = {f"_p_{n}": i.partial(key) for n, i in items.items()}
    if segments:
        spread = segments.number(spread, keys, forward)
        partials |= segments.partials()
    carries = spread.groupBy(*keys).agg(*[p.alias(n) for n, p in partials.items()])
    of_series = [f"_scan_by{k}" for k in range(len(by))]
    carries = carries.withColumns({"_scan_chunk": F.col("_scan_at._chunk")} | {c: F.col("_scan_at").getField(b) for c, b in zip(of_series, by)})
    over_chunks = _Frames(of_series, [F.col("_scan_chunk").asc()], [F.col("_scan_chunk").desc()])
    handed = {f"_c_{n}": i.carry(over_chunks, F.col(f"_p_{n}")) for n, i in items.items()}
    if segments:
        carries = segments.carried(carries, of_series)
        handed |= {f"_{way}_{n}": F.col(f"_{way}_{n}") for n in segments.values for way in ("in", "out")}
    carries = carries.select(*keys, *[c.alias(n) for n, c in handed.items()])

    inside = _Frames(keys, forward, backward)
    joined = spread.join(carries, keys, "left")
    found = {n: i.value(inside, F.col(f"_c_{n}")) if i.value else F.col(f"_c_{n}") for n, i in items.items()}
    if segments:
        found |= segments.columns(keys)
    return joined.select(*[c for c in df.columns if c not in found], *[c.alias(n) for n, c in found.items()])


def attach(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Join per-key aggregates back to the rows; partial aggregation keeps a hot key off a single task."""
    by = list(by)
    side = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(side, by, "left")
