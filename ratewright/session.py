"""Session defaults and the shared folder that written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks. On a cluster, bring your own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ratewright")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is chosen only where the session names none and
    runs on one machine, as tests do.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ratewright-"))
    return context.getCheckpointDir()


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ratewright/{label}-{uuid.uuid4().hex}"


def land(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back: later plans start from the table."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of an iteration: each step's is landed, and the one before the last is removed, as only
    the newest is read on."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, []

    def land(self, df: DataFrame) -> DataFrame:
        self.paths.append(new_shared_path(self.spark, self.label))
        df.write.parquet(self.paths[-1])
        if len(self.paths) > 2:
            self._remove(self.paths.pop(0))
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def close(self) -> None:
        """Remove what is left, once nothing lazy reads it."""
        while self.paths:
            self._remove(self.paths.pop())

    def _remove(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
