"""Recording-shaped tables derived from the given Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saccadia import schemas as S
from saccadia.operators.scan import scan, sum_before
from saccadia.plans.preprocess import preprocess_events
from saccadia.session import stage

DAY = 86_400_000
CHUNK = 5 * DAY  # the clock of these tables spans 30 days, a trial about six


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (seq, participant_id, trial_id, t, event_type, value, k)."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("participant_id"),
        F.floor((F.day("ts") - 1) / 6).alias("trial_id"),
        (F.floor(micros / 1000) - 1704067200000).alias("t"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _spread(factor: int, modulus: int, offset: int = 0) -> Column:
    return (F.col("seq") * factor % modulus + offset).cast("double")


def gaze_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = raw_marks(spark, sf_dir)
    ev = scan(ev, S.TRIAL, "t", ["seq"], {"n": sum_before(F.when(F.col("event_type") == "signup", 1).otherwise(0))},
              width=CHUNK)
    even, kind = F.col("k") % 2 == 0, F.col("event_type")
    ev = ev.withColumn("event", F.when(kind == "signup", "FIXPOINT").when(kind == "click", "ESACC")
                       .when(kind == "view", "EFIX")
                       .when(kind == "purchase", F.when(even, "SFIX").otherwise("SSACC"))
                       .otherwise(F.when(even, "SBLINK").otherwise("EBLINK")))
    event, t = F.col("event"), F.col("t")
    spans = event.isin("EFIX", "ESACC", "EBLINK")
    fixpoint, fix, sacc = event == "FIXPOINT", event == "EFIX", event == "ESACC"
    seq = F.col("seq")
    return ev.select(
        seq, *S.TRIAL, F.when(~spans, t).alias("time"), event,
        F.when(~fixpoint, F.when(even, "L").otherwise("R")).alias("eye"),
        F.when(fixpoint, F.when(F.col("n") % 3 == 0, S.WHITE).when(F.col("n") % 3 == 1, S.RED).otherwise(S.BLUE))
        .alias("colour"),
        F.when(fixpoint, _spread(7919, 2200, -100)).alias("stimulus_x"),
        F.when(fixpoint, _spread(104729, 1300, -100)).alias("stimulus_y"),
        F.when(spans, t.cast("double")).alias("start_time"),
        F.when(spans, (t + 20 + F.col("k")).cast("double")).alias("end_time"),
        F.when(spans, (20 + F.col("k")).cast("double")).alias("duration"),
        F.when(fix, _spread(7907, 2100, -90)).alias("x"), F.when(fix, _spread(7901, 1200, -60)).alias("y"),
        F.when(fix, F.col("value") * 10).alias("avg_pupil_size"),
        F.when(sacc, _spread(7883, 1921)).alias("start_x"), F.when(sacc, _spread(7879, 1081)).alias("start_y"),
        F.when(sacc, _spread(7877, 1921)).alias("end_x"), F.when(sacc, _spread(7873, 1081)).alias("end_y"),
        F.when(sacc, F.col("value") / 10).alias("amplitude"),
        F.when(sacc, F.col("value") * 3).alias("peak_velocity"),
        F.when(fixpoint & (seq % 3 == 0), _spread(7919, 2200, -93)).alias("pos_x"),
        F.when(fixpoint & (seq % 3 == 0), _spread(104729, 1300, -93)).alias("pos_y"),
        F.when(fixpoint & (seq % 2 == 0), _spread(31, 500, 100)).alias("distance"),
        F.when(fixpoint & (seq % 2 == 0), _spread(17, 90, 10)).alias("target_width"),
        F.when(fixpoint & (seq % 5 == 0), "cross").alias("target_shape"))


def gaze_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """START, END, TRIALID and TRIAL_VAR_DATA rows; some trials miss one or have a second END."""
    trials = raw_marks(spark, sf_dir).groupBy(*S.TRIAL).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    p, i = F.col("participant_id"), F.col("trial_id")
    at = p * 5 + i

    def mark(seq: int, event: str, time: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(seq).cast("bigint").alias("seq"), F.lit(event).alias("event"),
                                        time.alias("time")))

    marks = F.array(
        mark(-4, "TRIALID", F.col("t0") - 2, F.lit(True)), mark(-3, "START", F.col("t0") - 1, at % 11 != 0),
        mark(900000001, "END", F.col("t1") + 200, at % 13 != 0),
        mark(900000002, "TRIAL_VAR_DATA", F.col("t1") + 201, at % 19 != 0),
        mark(900000003, "END", F.col("t1") + 200, at % 7 == 0))
    data = F.col("m.event") == "TRIAL_VAR_DATA"
    elapsed = (F.col("t1") - F.col("t0")) / 1000.0 * 0.7
    return (trials.select("*", F.explode(F.array_compact(marks)).alias("m")).select(
        "m.seq", *S.TRIAL, "m.time", "m.event",
        F.when(data, F.when((p + i) % 2 == 0, "left").otherwise("right")).alias("side"),
        F.when(data & ((p * 3 + i) % 7 != 0), elapsed).alias("time_elapsed"),
        F.when(data, elapsed * 0.9).alias("delay"),
        F.when(data, F.when((p + i) % 17 == 0, "x").otherwise(((p + i) % 5).cast("string"))).alias("marks"),
        F.when(data & ((p + i) % 6 != 0), F.when((p + i) % 3 == 0, "circle").otherwise("square")).alias("shape"),
        F.when(data, ((p * 7 + i) % 5) * 1.5).alias("speed")))


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Hand-off table between two stages, written once per session to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def gaze_events(spark: SparkSession, sf_dir: str, experiment: str) -> DataFrame:
    """Raw events, as the log parser hands them over."""
    def build() -> DataFrame:
        return gaze_marks(spark, sf_dir).unionByName(gaze_body(spark, sf_dir), allowMissingColumns=True)

    return staged(spark, sf_dir, "raw_events", build).withColumn("experiment", F.lit(experiment))


def prepared_events(spark: SparkSession, sf_dir: str, experiment: str) -> DataFrame:
    """Preprocessed events of one experiment, as the feature functions read them."""
    def build() -> DataFrame:
        return preprocess_events(gaze_events(spark, sf_dir, experiment), experiment, width=CHUNK, validate=True)

    return staged(spark, sf_dir, f"events_{experiment}", build)


def gaze_samples(spark: SparkSession, sf_dir: str, experiment: str = "SHAPES") -> DataFrame:
    price, part = F.col("l_extendedprice"), F.col("l_partkey")
    left, right = part % 7 != 0, part % 11 != 0
    return table(spark, sf_dir, "lineitem").select(
        F.lit(experiment).alias("experiment"), (F.col("l_orderkey") * 1000003 + part).alias("seq"),
        F.col("l_suppkey").alias("participant_id"), F.col("l_linenumber").cast("bigint").alias("trial_id"),
        (F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 10).alias("time"),
        F.when(left, price % 2000 - 40).alias("x_left"), F.when(left, (price * 3) % 1180 - 50).alias("y_left"),
        F.when(right, price % 2000 - 40 + (F.col("l_quantity") - 25) / 10).alias("x_right"),
        F.when(right, (price * 3) % 1180 - 50 + F.col("l_discount") * 10).alias("y_right"),
        F.when(left, F.col("l_discount") * 100).alias("x_velocity_left"),
        F.when(left, F.col("l_tax") * 100).alias("y_velocity_left"),
        F.when(right, F.col("l_discount") * 90 + 1).alias("x_velocity_right"),
        F.when(right, F.col("l_tax") * 90 + 1).alias("y_velocity_right"))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return (table(spark, sf_dir, "events").select(user.alias("ID")).distinct().select(
        "ID", F.when(F.col("ID") % 2 == 0, "PATIENT").otherwise("CONTROL").alias("Group"),
        F.when(F.col("ID") % 9 != 0, 45000 + F.col("ID")).alias("Eye tracking date")))


def user_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small labelled feature matrix with a constant column and a collinear pair."""
    value, kind = F.col("value"), F.col("event_type")

    def only(name: str) -> Column:
        return F.when(kind == name, value)

    return (table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("participant_id")).agg(
        F.avg(only("click")).alias("click_mean"), F.max(only("click")).alias("click_max"),
        F.avg(only("view")).alias("view_mean"), F.stddev_samp(only("view")).alias("view_std"),
        F.min(only("error")).alias("error_min"),
        F.coalesce(F.sum(only("purchase")), F.lit(0.0)).alias("purchase_sum"),
        F.avg(value).alias("value_mean"), F.count("*").cast("double").alias("n_events"))
        .select("participant_id", (F.col("participant_id") % 2).cast("int").alias("y"), "click_mean", "click_max",
                "view_mean", "view_std", "error_min", "purchase_sum", "value_mean",
                (F.col("value_mean") * 2 + (F.col("participant_id") % 3) * 0.1).alias("value_twin"), "n_events",
                F.lit(1.0).alias("constant")))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), key.alias("seq"), F.col("o_orderdate").alias("date"),
        F.when(F.col("o_custkey") % 2 == 0, "PATIENT").otherwise("CONTROL").alias("category"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("q0_a"),
        F.when(key % 3 == 0, F.col("o_orderstatus")).alias("q0_b"),
        F.when(key % 10 >= 7, F.col("o_totalprice")).alias("q1_sparse"),
        F.when(key % 13 != 0, F.col("o_totalprice")).alias("q2"),
        F.concat(F.lit("['"), (key % 7).cast("string"), F.lit("', '"), ((key + 3) % 7).cast("string"), F.lit("']"))
        .alias("pain"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (vec_id, label, f0, f1, ...)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])
