"""Recorder logs: event lines and sample lines as column expressions."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.functions.scalars import cast_columns, plain_decimal, whole_number
from saccadia.operators.joins import assign_trials, trial_intervals
from saccadia.operators.scan import last, scan, sum_before
from saccadia.session import stage


def log_paths(folder: str, experiment: str) -> str:
    return f"{folder}/{S.EXPERIMENT_PREFIXES.get(experiment, experiment)}*.asc"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(recording, participant_id, block, position, line) of all matching files.

    Files stay splittable: a line is ordered by the start of its block in the file and by its place in that block.
    """
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    folder, _, pattern = path.rpartition("/")
    if folder and any(c in pattern for c in "*?[{"):
        # One listing of the folder; a glob would make every file a path that is looked up in a task of its own.
        files = spark.read.option("pathGlobFilter", pattern).text(folder)
        if not files.rdd.getNumPartitions():
            raise FileNotFoundError(path)
    else:
        files = spark.read.text(path)
    lines = files.select(
        name.alias("recording"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"), F.trim("value").alias("line"))
    return lines.withColumn("participant_id", F.get(F.split("recording", "_"), 1).try_cast("bigint"))


#: Lines are handed on, and long files read, in pieces of so many bytes.
PIECE_BYTES = 4 << 20
#: A task reads about so many bytes; opening a file counts as some.
TASK_BYTES, OPEN_BYTES = 128 << 20, 64 << 10


def _file_tasks(base: str, pattern: str, open_store: Callable[[], fs.FileSystem], block: int) -> tuple[Callable, Callable]:
    """Functions for mapInArrow: one lists the blocks of the files of a folder, the other reads their lines."""
    # Made inside a function, so that they travel to the workers with their code.
    piece_bytes, names = PIECE_BYTES, ["path", "start", "end", "size"]

    def files() -> Iterator[tuple[str, int]]:
        store = open_store()
        if isinstance(store, fs.LocalFileSystem):  # one by one: a folder may hold millions
            with os.scandir(base) as entries:
                yield from ((f"{base}/{e.name}", e.stat().st_size) for e in entries if e.is_file())
        else:
            yield from ((i.path, i.size) for i in store.get_file_info(fs.FileSelector(base)) if i.is_file)

    def listed(_: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for path, size in files():
            name = path.rpartition("/")[2]
            if fnmatch.fnmatchcase(name, pattern) and not name.startswith((".", "_")) and not name.endswith("._COPYING_"):
                found += [(path, at, min(at + block, size), size) for at in range(0, size, block)]
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names)

    def lines_of(store: fs.FileSystem, path: str, start: int, end: int, size: int) -> Iterator[list[bytes]]:
        """Lines that begin in a block, in pieces; a line ends with LF, CR or both."""
        mark = b"\xef\xbb\xbf"
        with store.open_input_file(path) as file:
            if start == 0 and end == size <= piece_bytes:
                yield file.read().removeprefix(mark).splitlines()
                return
            at, rest, ours, more = max(start - 1, 0), b"", start == 0, True
            file.seek(at)
            while more:
                piece = file.read(piece_bytes)
                more, parts = bool(piece), (rest + piece).splitlines(keepends=True)
                # what has no end yet, or a CR whose LF may follow
                rest = parts.pop() if more and parts and not parts[-1].endswith(b"\n") else b""
                found = []
                for line in parts:
                    if at >= end:
                        more = False
                        break
                    if ours:
                        text = line[:-2] if line.endswith(b"\r\n") else line[:-1] if line.endswith((b"\n", b"\r")) else line
                        found.append(text.removeprefix(mark) if at == 0 else text)
                    at, ours = at + len(line), True
                yield found

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, recordings, blocks, lines, held = open_store(), [], [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(recordings, pa.string()), pa.array(blocks, pa.int64()), pa.array(lines, pa.binary())],
                                              ["recording", "block", "value"])

        for rows in batches:
            for row in rows.to_pylist():
                # as Spark names files: characters that a URI cannot have are escaped
                name = re.sub(r'[\x00-\x20"%<>\\^`{|}\x7f\[\]#?]', lambda c: f"%{ord(c[0]):02X}", row["path"].rpartition("/")[2])
                for found in lines_of(store, row["path"], row["start"], row["end"], row["size"]):
                    lines += found
                    recordings += [name] * len(found)
                    blocks += [row["start"]] * len(found)
                    held += sum(map(len, found))
                    if held >= piece_bytes or len(lines) >= 50_000:
                        yield batch()
                        recordings, blocks, lines, held = [], [], [], 0
        if lines:
            yield batch()

    return listed, read


def staged_lines(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``read_lines``, written once. Tasks list and read the files, so the driver holds none of their names and a task
    reads many small ones; folders that only Spark reads, and other globs than ``*`` and ``?``, are left to Spark's reader."""
    folder, _, pattern = path.rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(folder or "/")
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    base = "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("file:"):
        open_store = fs.LocalFileSystem
    else:
        try:
            base = fs.FileSystem.from_uri(uri)[1]
        except (pa.ArrowInvalid, OSError):
            return stage(read_lines(spark, path), "lines")
        open_store = lambda: fs.FileSystem.from_uri(uri)[0]
    if any(c in path for c in "[]{}\\") or any(c in folder for c in "*?") or not any(c in pattern for c in "*?") or (
            open_store is fs.LocalFileSystem and not os.path.isdir(base)):
        return stage(read_lines(spark, path), "lines")
    block = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    listed, read = _file_tasks(base, pattern, open_store, block)
    blocks = stage(spark.range(0, 1, 1, 1).mapInArrow(listed, "path string, start long, end long, size long"), "blocks")
    n, size = blocks.agg(F.count("*"), F.sum(F.col("end") - F.col("start"))).first()
    if not n:
        return stage(read_lines(spark, path), "lines")  # says what is missing
    tasks = min(n, max(spark.sparkContext.defaultParallelism, -(-(size + n * OPEN_BYTES) // TASK_BYTES)))
    dealt = blocks.repartition(tasks, "path", "start").sortWithinPartitions("path", "start")
    lines = dealt.mapInArrow(read, "recording string, block long, value binary").select(
        "recording", "block", F.monotonically_increasing_id().alias("position"), F.trim(F.col("value").cast("string")).alias("line"))
    return stage(lines.withColumn("participant_id", F.get(F.split("recording", "_"), 1).try_cast("bigint")), "lines")


# How a line announces its event; the first rule that fits counts. Labels lines are no events.
LINE_RULES = [
    ("TRIAL_VAR_LABELS", "contains", "TRIAL_VAR_LABELS"), ("TRIALID", "contains", "TRIALID"),
    ("START", "starts", "START"), ("END", "starts", "END"),
    ("TRIAL_VAR_DATA", "contains", "!V TRIAL_VAR_DATA"), ("FIXPOINT", "contains", "FIXPOINT"),
    ("EFIX", "starts", "EFIX"), ("SFIX", "starts", "SFIX"), ("ESACC", "starts", "ESACC"),
    ("SSACC", "starts", "SSACC"), ("SBLINK", "starts", "SBLINK"), ("EBLINK", "starts", "EBLINK"),
]

# Token positions of the measures, counted from 0; whole numbers first, decimals second.
MEASURES = {
    "EFIX": ({"start_time": 2, "end_time": 3, "duration": 4}, {"x": 5, "y": 6, "avg_pupil_size": 7}),
    "ESACC": ({"start_time": 2, "end_time": 3, "duration": 4},
              {"start_x": 5, "start_y": 6, "end_x": 7, "end_y": 8, "amplitude": 9, "peak_velocity": 10}),
    "EBLINK": ({"start_time": 2, "end_time": 3, "duration": 4}, {}),
}


def line_event(line: Column) -> Column:
    return F.coalesce(*[F.when(line.contains(text) if how == "contains" else line.startswith(text), F.lit(event))
                        for event, how, text in LINE_RULES])


def parse_events(lines: DataFrame, experiment: str, axis: str = "block", ties: Sequence[str] = ("position",),
                 chunk: Column | None = None) -> DataFrame:
    """Raw events from ordered log lines (recording, participant_id, line, order columns).

    The trial id and the variable labels last seen in the recording hold until the next ones. ``seq`` numbers the lines
    of a participant, recording after recording, so that it stays unique where a participant has several.
    """
    tokens, event = F.split("line", r"\s+"), F.col("event")
    typed = lines.withColumn("event", line_event(F.col("line"))).withColumn("tok", tokens)
    context = {
        "_trial": last(F.when(event == "TRIALID", F.element_at("tok", -1).try_cast("bigint"))),
        "_labels": last(F.when(event == "TRIAL_VAR_LABELS", F.slice("tok", 4, F.greatest(F.size("tok") - 3, F.lit(0))))),
        "seq": sum_before(F.lit(1)),
    }
    rows = scan(typed, ["recording", "participant_id"], axis, ties, context, chunk=F.col(axis) if chunk is None else chunk)
    # One row per recording: the lines of the recordings before it.
    earlier = W.partitionBy("participant_id").orderBy("recording").rowsBetween(W.unboundedPreceding, -1)
    sizes = (lines.groupBy("participant_id", "recording").agg(F.count("*").alias("_n"))
             .select(F.col("participant_id").alias("_p"), F.col("recording").alias("_r"),
                     F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    same = F.col("participant_id").eqNullSafe(F.col("_p")) & (F.col("recording") == F.col("_r"))
    rows = rows.join(sizes, same).withColumn("seq", F.col("seq") + F.col("_before"))
    rows = rows.where(event.isNotNull() & (event != "TRIAL_VAR_LABELS"))

    def token(i: int) -> Column:
        return F.get("tok", F.lit(i))

    stamped = event.isin("TRIALID", "START", "END", "TRIAL_VAR_DATA", "FIXPOINT")
    starting = event.isin("SFIX", "SSACC", "SBLINK")
    time = F.when(stamped, token(1)).when(starting, F.element_at("tok", -1)).try_cast("bigint")
    fixpoint = event == "FIXPOINT"
    measures: dict[str, list[Column]] = {}
    for kind, (whole, decimal) in MEASURES.items():
        for name, i in whole.items():
            measures.setdefault(name, []).append(F.when(event == kind, whole_number(token(i))))
        for name, i in decimal.items():
            measures.setdefault(name, []).append(F.when(event == kind, plain_decimal(token(i))))
    n = F.size("_labels")
    values = F.slice("tok", F.greatest(F.size("tok") - n + 1, F.lit(1)), n)
    variables = [F.when(event == "TRIAL_VAR_DATA", F.get(values, (F.array_position("_labels", v) - 1).cast("int"))).alias(v)
                 for v in S.TRIAL_VARIABLES]
    return rows.select(
        "seq", F.lit(experiment).alias("experiment"), "participant_id", F.col("_trial").alias("trial_id"),
        time.alias("time"), "event",
        F.when(starting | event.isin(*MEASURES), token(1)).alias("eye"),
        F.when(fixpoint, F.array_join(F.slice("tok", 5, 3), " ")).alias("colour"),
        F.when(fixpoint, token(10).try_cast("double")).alias("stimulus_x"),
        F.when(fixpoint, token(11).try_cast("double")).alias("stimulus_y"),
        *[F.coalesce(*c).alias(name) for name, c in measures.items()], *variables)


def extract_events(spark: SparkSession, folder: str, experiment: str) -> DataFrame:
    """Raw events of all recordings of an experiment in one scan; the files, which may be many and small, are read once."""
    return parse_events(staged_lines(spark, log_paths(folder, experiment)), experiment)


# --- samples ---------------------------------------------------------------------------------------------------------

def eye_layouts(events: DataFrame) -> DataFrame:
    """Tracked eyes per participant as a layout name; participants without any are left out."""
    left, right = F.max(F.col("eye") == "L"), F.max(F.col("eye") == "R")
    return (events.groupBy("participant_id").agg(left.alias("l"), right.alias("r"))
            .select("participant_id", F.when(F.col("l") & F.col("r"), "LR").when(F.col("l"), "L").when(F.col("r"), "R")
                    .alias("layout")).where("layout is not null"))


def parse_samples(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Typed samples from tab separated lines; what does not parse, the dot included, is missing."""
    cells = lines.join(layouts, "participant_id").withColumn("_cells", F.split("line", "\t"))

    def cell(column: str) -> Column:
        found = [F.when(F.col("layout") == name, F.trim(F.get("_cells", F.lit(order.index(column)))))
                 for name, order in S.SAMPLE_LAYOUTS.items() if column in order]
        return F.coalesce(*found)

    return cells.select("participant_id", F.col("position").alias("seq"), *[
        cell(c).try_cast(kind).alias(c) for c, kind in S.SAMPLE_TYPES.items()
        if c not in ("experiment", "participant_id", "trial_id")])


def samples_of_trials(lines: DataFrame, events: DataFrame, experiment: str, trial_key: str = "trial_id",
                      width: int = 60_000) -> DataFrame:
    """Samples inside the trials of cleaned events, with the standard columns."""
    rest = events.where(F.col("event") != "FIXPOINT")
    samples = parse_samples(lines, eye_layouts(rest)).where(F.col("time").isNotNull())
    placed = assign_trials(samples, trial_intervals(rest, trial_key), width).withColumn("experiment", F.lit(experiment))
    return placed.select(*cast_columns([*S.SAMPLE_TYPES, "seq"], S.SAMPLE_TYPES))


def extract_samples(spark: SparkSession, folder: str, events: DataFrame, experiment: str, **options) -> DataFrame:
    return samples_of_trials(read_lines(spark, log_paths(folder, experiment)), events, experiment, **options)
