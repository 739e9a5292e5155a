"""Spark sessions and tables that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Lets Spark delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, **more: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("procweave")
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "6g"} | more
    return builder.config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, without which only a session on one machine can do."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.master", "")
    if not named and master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Staging:
    """Tables written to the shared folder, so that later steps don't depend on
    executors that may be lost, and that are dropped when no longer needed."""

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/procweave-{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        self.names.add(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with settings(self.spark, {CLEANUP: "true"}):  # what is written is read from its files, so no shuffle is used again
            writer.parquet(path)
        return self.read(df, name)

    def read(self, df: DataFrame, name: str) -> DataFrame:
        """The table of that name; df gives its schema, which an empty table lacks."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        for name in self.names - set(names):
            self.drop(name)

    def drop(self, name: str = "") -> None:
        if not hasattr(self.spark, "_jvm"):  # a remote session has no file system at hand: the folder's owner clears it
            return
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(conf).delete(path, True)
        self.names -= {name} if name else set(self.names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes up to which a table of known rows is broadcast.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df, marked for broadcasting if its rows, counted before, take at most BROADCAST_BYTES; else a join shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
