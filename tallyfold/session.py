"""Session settings and the shared scratch area used to cut lineage.

Iterative jobs write their small state tables as Parquet below the directory in
``spark.checkpoint.dir``.  Reading the table back gives Catalyst its true size,
so a join with it is broadcast only when it is below
``spark.sql.autoBroadcastJoinThreshold`` and shuffled otherwise; and the files
survive the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def build_session(app: str = "tallyfold", **conf: str) -> SparkSession:
    """A session with the adaptive settings the operators rely on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    Only a local master, whose executors share the driver's disk, may go without: it gets a temporary one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def watched(write: Callable[[DataFrame], DataFrame], table: DataFrame, sums: Sequence[Column]) -> tuple[DataFrame, dict]:
    """The written table and aggregates over its rows, taken by the very job that writes it.

    They belong to the last stage, whose tasks count once however often earlier stages are repeated after the loss of
    an executor.
    """
    seen = Observation()
    out = write(table.observe(seen, *sums))
    return out, seen.get


class Scratch:
    """Tables of one job in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tallyfold-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{name}"

    def cut(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write ``df`` once and return a scan of the written table."""
        where = self.path(name)
        df.write.mode("errorifexists").parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._tallyfold_path = where
        return out

    def cut_by(self, df: DataFrame, key: str | Sequence[str], parts: int, name: str = "table") -> DataFrame:
        """Like :meth:`cut`, for rows that are dealt into ``parts`` by ``key`` (a column or several): the scan knows it and they do not move again.

        The table leaves the catalogue at once; its files stay below the shared folder like any other.
        """
        where, table = self.path(name), f"tallyfold_{uuid.uuid4().hex}"
        df.write.bucketBy(parts, *([key] if isinstance(key, str) else key)).option("path", where).format("parquet").saveAsTable(table)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        out._tallyfold_path = where
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table made by :meth:`cut` that no later step reads."""
        where = getattr(df, "_tallyfold_path", None)
        if where is None:
            return
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
