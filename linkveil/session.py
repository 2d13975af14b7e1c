"""Session set-up and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster use the one the cluster gives."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where that is unset and all run on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_linkveil_shared", None)
    if own is None:
        own = spark.sparkContext._linkveil_shared = "file://" + tempfile.mkdtemp(prefix="linkveil-")
    return own


def _made(spark: SparkSession) -> list[str]:
    """Paths of intermediate tables that are still there, oldest first."""
    if not hasattr(spark.sparkContext, "_linkveil_made"):
        spark.sparkContext._linkveil_made = []
    return spark.sparkContext._linkveil_made


def made(spark: SparkSession) -> int:
    """How many intermediate tables there are."""
    return len(_made(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/linkveil/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    _made(spark).append(path)
    return path


def drop_made(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the intermediate tables made since there were `since` of them, but for the last `keep`. Nothing may read them any more."""
    made = _made(spark)
    last = made[len(made) - keep :] if keep else []
    for path in made[since : len(made) - keep]:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    made[since:] = last


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
