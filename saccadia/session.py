"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "saccadia", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by ``spark.checkpoint.dir``; only a local session may fall back to a scratch folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        scratch = tempfile.mkdtemp(prefix="saccadia-checkpoint-")
        atexit.register(shutil.rmtree, scratch, ignore_errors=True)
        sc.setCheckpointDir(scratch)
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that every executor can reach")
    return sc.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back, columns pruned per use."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    delete_at_end(spark, path.rpartition("/")[0])
    return spark.read.parquet(path)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver's JVM ends; until then a lost executor can read it again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
