"""Language identification: a convolutional network over bytes, trained in numpy on a bounded labelled sample.

A text is cut into consecutive windows of ``WINDOW`` bytes, the last one padded with zeros. Bytes are embedded, filters of
several widths run over them, each filter keeps its largest response in the window, and a softmax layer reads those. The
whole text counts: the log probabilities of all its windows are averaged, weighted by their bytes.

At prediction time a filter of width w over embedded bytes is a sum of table lookups, one per pair of bytes, so the tables
are built once per worker from the few thousand parameters that travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release_memory, text_or_empty

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: Windows that one pass over the tables handles; keeps the intermediate arrays inside the cache.
WINDOWS_AT_ONCE = 48
#: Answer for texts that are NULL or hold no letter.
UNKNOWN = "und"


@dataclass(frozen=True)
class SampleBound:
    """How much labelled text the fit may see, whatever the table holds."""

    per_language: int = 400
    windows_per_text: int = 6
    languages: int = 500


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    embed: np.ndarray            # 256 x EMBED
    filters: dict[int, np.ndarray]  # width -> width x EMBED x FILTERS
    bias: np.ndarray             # widths x FILTERS
    dense: np.ndarray            # widths * FILTERS x languages
    dense_bias: np.ndarray


# ---------------------------------------------------------------- training

def _pooled(windows: np.ndarray, p: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Largest response of every filter and where it is."""
    x = p["embed"][windows]
    out, at = [], []
    for k, w in enumerate(WIDTHS):
        spans = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2)
        flat = np.ascontiguousarray(spans).reshape(-1, w * EMBED)
        conv = (flat @ p[f"w{w}"].reshape(w * EMBED, FILTERS)).reshape(len(windows), -1, FILTERS)
        best = conv.argmax(axis=1)
        out.append(np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + p["bias"][k])
        at.append(best)
    return np.concatenate(out, axis=1), at


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradients(windows: np.ndarray, target: np.ndarray, p: dict) -> dict:
    pooled, at = _pooled(windows, p)
    hidden = np.maximum(pooled, 0)
    error = _softmax(hidden @ p["dense"] + p["dense_bias"])
    error[np.arange(len(target)), target] -= 1
    error /= len(target)
    back = (error @ p["dense"].T) * (pooled > 0)
    g = {"dense": hidden.T @ error, "dense_bias": error.sum(axis=0), "bias": back.sum(axis=0).reshape(len(WIDTHS), FILTERS),
         "embed": np.zeros_like(p["embed"])}
    row = np.arange(len(windows))[:, None, None]
    for k, w in enumerate(WIDTHS):
        b = back[:, k * FILTERS:(k + 1) * FILTERS]
        codes = windows[row, at[k][:, :, None] + np.arange(w)]
        g[f"w{w}"] = np.einsum("nf,nfwd->wdf", b, p["embed"][codes])
        np.add.at(g["embed"], codes, b[:, :, None, None] * p[f"w{w}"].transpose(2, 0, 1)[None])
    return g


def _padded(texts: Iterable[bytes]) -> np.ndarray:
    texts = list(texts)
    out = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        out[i, :min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    return out


def train(samples: list[tuple[str, str]], epochs: int = 4, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Model:
    """Fit on (language, passage of at most WINDOW bytes); half of the steps see passages cut short, for short texts."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted({s[0] for s in samples}))
    if not languages:
        return Model((), np.zeros((256, EMBED), np.float32), {}, np.zeros((len(WIDTHS), FILTERS)), np.zeros((0, 0)), np.zeros(0))
    raw = _padded(s[1].encode("utf-8", "surrogatepass") for s in samples)
    target = np.array([languages.index(s[0]) for s in samples])
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros((len(WIDTHS), FILTERS)),
         "dense": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))), "dense_bias": np.zeros(len(languages))}
    p |= {f"w{w}": rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    mean, square, steps = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    share = np.bincount(target, minlength=len(languages)).astype(float)
    odds = (1 / share)[target]
    odds /= odds.sum()
    for _ in range(epochs):
        order = rng.choice(len(raw), size=len(raw), p=odds)  # every language as often as the others
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            windows = raw[part].copy()
            if steps % 2:
                cut = rng.integers(4, WINDOW, len(part))
                windows[np.arange(WINDOW)[None] >= cut[:, None]] = 0
            steps += 1
            for k, g in _gradients(windows, target[part], p).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                p[k] -= rate * (mean[k] / (1 - 0.9 ** steps)) / (np.sqrt(square[k] / (1 - 0.999 ** steps)) + 1e-8)
                p[k] = p[k].astype(np.float32, copy=False)
    return Model(languages, p["embed"], {w: p[f"w{w}"] for w in WIDTHS}, p["bias"], p["dense"], p["dense_bias"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no fit may see."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, bound: SampleBound = SampleBound()) -> Model:
    """Train on passages of a hash sample of the labelled, not held-out texts, about equally many per language.

    The driver receives at most ``per_language * windows_per_text`` passages of ``WINDOW`` characters per language and at
    most ``languages`` languages, the most frequent ones.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    counts = (labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(bound.languages)).collect()
    if not counts:
        return train([])
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, bound.per_language / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    step = F.greatest(F.lit(0), F.length("text") - WINDOW) / float(max(bound.windows_per_text - 1, 1))
    spots = F.array_distinct(F.array(*[(step * i).cast("int") for i in range(bound.windows_per_text)]))
    sample = (labelled.withColumn("draw", draw).filter(F.col("draw") < F.try_element_at(share, F.col("lang")))
              .select("draw", "doc_id", "lang", F.transform(spots, lambda i: F.substring("text", i + 1, WINDOW)).alias("parts"))
              .orderBy("draw", "doc_id").limit(2 * bound.per_language * len(counts)))
    return train([(r["lang"], part) for r in sample.collect() for part in r["parts"] if any(c.isalpha() for c in part)])


# ---------------------------------------------------------------- prediction

class Predictor:
    """The network as lookup tables over byte pairs."""

    def __init__(self, model: Model):
        self.model = model
        one = {w: np.einsum("bd,wdf->wbf", model.embed, f).astype(np.float32) for w, f in model.filters.items()}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.two = pair(one[2][0], one[2][1])
        self.three, self.third = pair(one[3][0], one[3][1]), one[3][2]
        self.four, self.last = pair(one[4][0], one[4][1]), pair(one[4][2], one[4][3])

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        codes = windows[:, :-1].astype(np.uint16) * np.uint16(256) + windows[:, 1:]
        pooled = np.concatenate([
            self.two[codes].max(axis=1),
            (self.three[codes[:, :-1]] + self.third[windows[:, 2:]]).max(axis=1),
            (self.four[codes[:, :-2]] + self.last[codes[:, 2:]]).max(axis=1)], axis=1) + self.model.bias.ravel()
        z = np.maximum(pooled, 0) @ self.model.dense + self.model.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Best language and its probability for each text; no letter: UNKNOWN and 0."""
        wide = texts.cast(pa.large_string())
        letters = pc.match_substring_regex(wide, r"\p{L}").to_numpy(zero_copy_only=False)
        ends = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset:wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
        size = np.diff(ends)
        per_text = np.where(letters, -(-size // WINDOW), 0)
        owner = np.repeat(np.arange(len(size)), per_text)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        start = ends[owner] + nth * WINDOW
        length = np.minimum(ends[owner + 1] - start, WINDOW)
        total = np.zeros((len(size), len(self.model.languages)))
        span = np.arange(WINDOW)
        for at in range(0, len(owner), WINDOWS_AT_ONCE):
            part = slice(at, at + WINDOWS_AT_ONCE)
            where = start[part, None] + span
            inside = span < length[part, None]
            windows = np.where(inside, data[np.minimum(where, len(data) - 1)], 0).astype(np.uint8)
            np.add.at(total, owner[part], self.log_probabilities(windows) * length[part, None])
        mean = total / np.maximum(size, 1)[:, None]
        chance = _softmax(mean) if len(self.model.languages) else np.zeros((len(size), 0))
        known = letters & (chance.shape[1] > 0)
        best = chance.argmax(axis=1) if chance.shape[1] else np.zeros(len(size), int)
        names = [self.model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
        score = np.where(known, chance.max(axis=1, initial=0), 0.0)
        return names, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text and nothing else.

    NULL texts and texts without a letter give ``und`` with score 0, as does a model without languages. Repeated rows
    stay. Texts of any length are read window by window. An empty table gives an empty result.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model) if model.languages else None
        for batch in batches:
            names, score = predictor.predict(batch.column(2)) if predictor else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       text_or_empty().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``.

    NULL texts and texts without a letter go, repeated rows stay or go together, an empty table stays empty.
    """
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(model) if model.languages else None
        for batch in batches:
            if predictor:
                names, score = predictor.predict(pc.fill_null(batch.column(at), ""))
                yield batch.filter(pa.array((score >= least) & (np.array(names, object) != UNKNOWN)))
        del predictor
        release_memory()  # the worker goes on with other stages

    return docs.mapInArrow(run, docs.schema)
