"""Removal of saccades that contain a blink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.operators.scan import DEFAULT_CHUNK, Segments, order_key, running_max, scan


def saccade_segments(axis: str, tie: str) -> Segments:
    """Over each stretch of a trial up to an ESACC: is it closed, its first SSACC, its last SBLINK and EBLINK."""
    event, key = F.col("event"), order_key(axis, [tie])
    of = lambda name: F.when(event == name, key)
    return Segments(event == "ESACC", {"_closed": (F.max, F.when(event == "ESACC", 1)), "_from": (F.min, of("SSACC")),
                                       "_s": (F.max, of("SBLINK")), "_e": (F.max, of("EBLINK"))})


def drop_blinked_spans(scanned: DataFrame, axis: str, tie: str) -> DataFrame:
    """Drop rows from the first SSACC to the ESACC of a stretch that has SBLINK and EBLINK in between.

    Needs the columns of ``saccade_segments``.
    """
    key = order_key(axis, [tie])
    blinked = (F.col("_closed").isNotNull() & (F.col("_s") > F.col("_from")) & (F.col("_e") > F.col("_from")) & (key >= F.col("_from")))
    for c in S.trial_of(scanned):
        blinked = blinked & F.col(c).isNotNull()
    return scanned.where(~F.coalesce(blinked, F.lit(False))).drop("_closed", "_from", "_s", "_e")


def drop_blink_saccades(events: DataFrame, axis: str = "time", tie: str = "seq", mode: str = "scan",
                        width: int = DEFAULT_CHUNK) -> DataFrame:
    """Remove saccades with a blink, then the blink and start events.

    ``mode='scan'`` follows the row order of the trial; ``mode='overlap'`` removes an ESACC when a blink of the same
    eye overlaps its interval.
    """
    if mode == "scan":
        kept = drop_blinked_spans(scan(events, S.trial_of(events), axis, [tie], {}, width=width, segments=saccade_segments(axis, tie)), axis, tie)
    elif mode == "overlap":
        kept = _without_overlapped(events, tie, width)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return kept.where(~F.col("event").isin("SBLINK", "EBLINK", "SFIX", "SSACC"))


def _without_overlapped(events: DataFrame, tie: str, width: int) -> DataFrame:
    # A saccade [s, e] is blinked when some blink [b, c] has b <= e and c >= s: among the blinks that start no later
    # than e, the one that ends last decides. That is a running maximum over saccade ends and blink starts.
    event = F.col("event")
    is_blink, by = event == "EBLINK", S.trial_of(events)
    marks = events.where(event.isin("ESACC", "EBLINK") & F.col("eye").isNotNull()).select(
        *by, "eye", F.col(tie), "event", "start_time", "end_time",
        F.when(is_blink, F.col("start_time")).otherwise(F.col("end_time")).alias("_at"),
        F.when(is_blink, 0).otherwise(1).alias("_rank"))
    seen = scan(marks, [*by, "eye"], "_at", ["_rank", tie],
                {"_blink_end": running_max(F.when(is_blink, F.col("end_time")))}, width=width)
    blinked = (seen.where((event == "ESACC") & (F.col("_blink_end") >= F.col("start_time")))
               .select(*by, F.col(tie)))
    return events.join(blinked, [*by, tie], "left_anti")
