"""Recorder files: the given tables are written as log and sample files, and read back through the sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.operators.scan import scan, sum_before
from saccadia.plans import stages
from saccadia.session import delete_at_end, ensure_checkpoint_dir
from saccadia.sources import logs, tables
from workload import ctes, event_queries, inputs
from workload.event_queries import rounded_doubles
from workload.sqltools import query

SPARK: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return keep


_WRITTEN: dict[tuple[str, str, str], str] = {}


def new_folder(spark, name: str) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return path if ":" in path.split("/")[0] else f"file://{path}"


def write_files(lines: DataFrame, order: Sequence[str], folder: str) -> None:
    """One file per ``recording`` with its lines in order; a task writes a file at a time and holds a batch of lines."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, out, n = None, None, 0
        for batch in batches:
            for recording, part in batch.groupby("recording", sort=False):
                if recording != name:
                    if out is not None:
                        out.close()
                    name, out, n = recording, store.open_output_stream(f"{base}/{recording}"), n + 1
                out.write(("\n".join(part["line"]) + "\n").encode())
        if out is not None:
            out.close()
        yield pd.DataFrame({"files": [n]})

    dealt = lines.repartition("recording").sortWithinPartitions("recording", *order)
    dealt.select("recording", "line").mapInPandas(run, "files long").agg(F.sum("files")).collect()


def written(spark, sf: str, name: str, build) -> str:
    """Folder of the files, written once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        folder = new_folder(spark, name)
        write_files(*build(), folder)
        delete_at_end(spark, folder)
        _WRITTEN[key] = folder
    return _WRITTEN[key]


def event_files(spark, sf: str) -> str:
    """Every trial is a recording of its own, so participants have several."""
    def build():
        lines = event_queries.log_lines(spark, sf)
        name = F.concat_ws("_", F.lit("Shapes"), F.col("participant_id").cast("string"), F.concat(F.col("part").cast("string"), F.lit(".asc")))
        return lines.withColumn("recording", name), ["part", "at", "place", "line_no"]

    return written(spark, sf, "event_files", build)


COLUMNS = ["participant_id", "trial_id", "time", "event", "eye", "colour", "stimulus_x", "stimulus_y", "start_time", "end_time", "duration",
           "x", "y", "avg_pupil_size", "start_x", "start_y", "end_x", "end_y", "amplitude", "peak_velocity", "side", "marks", "shape"]


def parsed(events: DataFrame) -> DataFrame:
    return rounded_doubles(events.select(*COLUMNS, F.col("time_elapsed").try_cast("double").alias("time_elapsed")))


@register("events_from_files", event_queries.SQL["asc_roundtrip"])
def events_from_files(spark, sf):
    return parsed(logs.extract_events(spark, event_files(spark, sf), "SHAPES"))


@register("line_numbers", query(ctes.GAZE, """
select participant_id, trial_id, event, cast(row_number() over (partition by participant_id order by trial_id,
  coalesce(time, cast(start_time as bigint)), seq) as bigint) as place from gaze"""))
def line_numbers(spark, sf):
    """Order of the events of a participant over all their recordings; ``seq`` counts all lines, so its rank is compared."""
    rows = logs.extract_events(spark, event_files(spark, sf), "SHAPES").select("participant_id", "trial_id", "event", "seq")
    ahead = rows.groupBy("participant_id", "trial_id").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    earlier = ahead.alias("a").join(ahead.alias("b"), (F.col("a.participant_id") == F.col("b.participant_id")) & (F.col("b.first") < F.col("a.first")), "left")
    before = earlier.groupBy(F.col("a.participant_id").alias("participant_id"), F.col("a.trial_id").alias("trial_id")).agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    numbered = scan(rows, S.TRIAL, "seq", [], {"inside": sum_before(F.lit(1))}, width=1_000_000)
    return numbered.join(before, S.TRIAL).select("participant_id", "trial_id", "event", (F.col("inside") + F.col("before") + 1).alias("place"))


@register("stage_round_trip", event_queries.SQL["clean_shapes"].replace("select * from clean", """
select experiment, participant_id, trial_id, event, eye, coalesce(time, cast(start_time as bigint)) as at, round(amplitude, 6) as amplitude,
 duration from clean"""))
def stage_round_trip(spark, sf):
    """Files to raw events to valid trials, each stage written as a table, partitions of the experiment overwritten twice."""
    raw, clean = new_folder(spark, "raw_table"), new_folder(spark, "clean_table")
    for _ in range(2):
        stages.extract_event_stage(spark, event_files(spark, sf), raw, ["SHAPES"])
    stages.clean_stage(spark, raw, clean, ["SHAPES"])
    for folder in (raw, clean):
        delete_at_end(spark, folder)
    rows = tables.read_parquet(spark, clean, experiment="SHAPES")
    at = F.coalesce("time", F.col("start_time").cast("bigint"))
    return rounded_doubles(rows.select("experiment", *S.TRIAL, "event", "eye", at.alias("at"), "amplitude", "duration"))


@register("csv_round_trip", "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) as o_totalprice, cast(o_orderdate as date) as o_orderdate from orders")
def csv_round_trip(spark, sf):
    folder = new_folder(spark, "sheet")
    rows = inputs.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    tables.write_csv(rows, folder)
    delete_at_end(spark, folder)
    return rounded_doubles(tables.read_csv(spark, folder, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date"))


# --- samples ---------------------------------------------------------------------------------------------------------

MEASURED = ["x_left", "y_left", "x_velocity_left", "y_velocity_left", "x_right", "y_right", "x_velocity_right", "y_velocity_right"]


def layout():
    """Participants are tracked with both eyes, the left or the right one."""
    of = F.col("participant_id") % 3
    return F.when(of == 0, "LR").when(of == 1, "L").otherwise("R")


def sample_files(spark, sf: str) -> str:
    def build():
        rows = inputs.gaze_samples(spark, sf)
        text = {c: F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("time", *MEASURED)}
        cell = lambda c: text[c] if c in text else F.lit(".")
        line = F.coalesce(*[F.when(layout() == name, F.concat_ws("\t ", *[cell(c) for c in order])) for name, order in S.SAMPLE_LAYOUTS.items()])
        name = F.concat_ws("_", F.lit("Shapes"), F.col("participant_id").cast("string"), F.concat((F.col("seq") % 4).cast("string"), F.lit(".asc")))
        return rows.select(name.alias("recording"), "time", "seq", line.alias("line")), ["time", "seq"]

    return written(spark, sf, "sample_files", build)


def tracked(spark, sf: str) -> DataFrame:
    """Events that say which eyes are tracked and when the trials of each participant began and ended, some at the same time."""
    spans = inputs.gaze_samples(spark, sf).groupBy(*S.TRIAL).agg(F.min("time").alias("a"))
    mark = lambda event, at, eye, on: F.when(on, F.struct(F.lit(event).alias("event"), at.alias("time"), F.lit(eye).cast("string").alias("eye")))
    always = F.lit(True)
    marks = F.array_compact(F.array(mark("START", F.col("a"), None, always), mark("END", F.col("a") + 4000, None, always),
                                    mark("EFIX", F.col("a"), "L", layout() != "R"), mark("EFIX", F.col("a"), "R", layout() != "L")))
    return spans.select(*S.TRIAL, F.explode(marks).alias("m")).select(*S.TRIAL, "m.event", "m.time", "m.eye")


@register("samples_from_files", query(ctes.SAMPLES + """,
spans as (select participant_id, trial_id, min(time) as a, min(time) + 4000 as b from samples group by all),
placed as (select s.*, (select max(i.trial_id) from spans i where i.participant_id = s.participant_id and s.time between i.a and i.b) as trial
 from samples s)""", """
select participant_id, trial as trial_id, time, """ + ", ".join(
    f"case when participant_id % 3 <> {1 if c.endswith('right') else 2} then round({c}, 6) + 0.0::double end as {c}" for c in MEASURED) + """
 from placed where trial is not null"""))
def samples_from_files(spark, sf):
    rows = logs.extract_samples(spark, sample_files(spark, sf), tracked(spark, sf), "SHAPES", width=2000)
    return rounded_doubles(rows.select(*S.TRIAL, "time", *MEASURED))


@register("eye_layouts", "select l_suppkey as participant_id, case l_suppkey % 3 when 0 then 'LR' when 1 then 'L' else 'R' end as layout from lineitem group by all")
def eye_layouts(spark, sf):
    return logs.eye_layouts(tracked(spark, sf))
