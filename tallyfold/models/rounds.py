"""Rounds of a fit that outlive its driver.

Each round is a folder below one shared folder: first the parameter table, then a one-row table with the scalars
(prior, trace, identity of the fit).  Spark marks a written table by ``_SUCCESS``, which is the commit of the round:
a round without a marked state table never happened and is written over.  Two rounds are kept, because the
posterior of a fit belongs to the parameters before the last ones.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(ann: DataFrame, **settings) -> str:
    """Settings of a fit and an order-free checksum of its annotations."""
    rows = F.xxhash64("task_id", "worker_id", "label").cast("decimal(38,0)")
    row = ann.agg(F.count("*").alias("n"), F.sum(rows).alias("sum")).first()
    return json.dumps({**settings, "rows": row["n"], "checksum": str(row["sum"])}, sort_keys=True, default=str)


class Rounds:
    def __init__(self, spark: SparkSession, root: str, fit: str):
        self.spark, self.root, self.fit = spark, root.rstrip("/"), fit

    def _params(self, t: int) -> str:
        return f"{self.root}/round-{t:06d}/params"

    def _state(self, t: int) -> str:
        return f"{self.root}/round-{t:06d}/state"

    def write(self, t: int, params: DataFrame) -> DataFrame:
        """The parameters of round ``t``; not committed yet."""
        params.write.mode("overwrite").parquet(self._params(t))
        return self._read(t)

    def commit(self, t: int, state: dict) -> None:
        row = self.spark.createDataFrame([(self.fit, json.dumps(state))], "fit string, state string")
        row.coalesce(1).write.mode("overwrite").parquet(self._state(t))

    def _read(self, t: int) -> DataFrame:
        out = self.spark.read.parquet(self._params(t))
        out._tallyfold_path = self._params(t)
        return out

    def last(self) -> tuple[int, DataFrame, DataFrame, dict] | None:
        """Number, parameters before, parameters and scalars of the last committed round."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.root).getFileSystem(conf)
        if not fs.exists(path(self.root)):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(path(self.root))]
        known = sorted((int(n[6:]) for n in names if n.startswith("round-")), reverse=True)
        for t in known:
            if fs.exists(path(f"{self._state(t)}/_SUCCESS")):
                row = self.spark.read.parquet(self._state(t)).first()
                if row["fit"] != self.fit:
                    raise ValueError(f"{self.root} holds the rounds of another fit")
                return t, self._read(t - 1), self._read(t), json.loads(row["state"])
        return None
