"""Intermediate tables in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it again.
The folder comes from ``spark.checkpoint.dir`` or, where that is unset, from the
context's checkpoint directory; only on ``local`` masters (tests, a laptop) without
either is a folder of our own made, so that on a cluster nothing is ever put on one
machine's disk.  A written table survives the loss of any executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, from the session or made once for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = given.get() if given.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir (or the context's checkpoint directory) to a folder all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Rows for work that is heavy for its bytes: dealt out anew where the scan gives fewer partitions than there are cores.

    That is so for small tables only (or few, huge row groups); a large table is worked on
    where it is read and is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    planned = df._jdf.queryExecution()
    if planned.executedPlan().nodeName() == "AdaptiveSparkPlan":  # it has a shuffle already; to ask further would run it
        return df
    return df.repartition(2 * cores) if planned.toRdd().getNumPartitions() < cores else df


class Workspace:
    """Hands out tables for one run of an operator and deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/loomgraph/{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._quietly_drop_all)

    def cut(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}_{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path  # type: ignore[attr-defined]
        return out

    def together(self, tables: list[DataFrame]) -> DataFrame:
        """Tables of :meth:`cut` with one schema, read by a single scan."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._workspace_path for t in tables])  # type: ignore[attr-defined]

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table of :meth:`cut` that nothing will read again."""
        path = getattr(df, "_workspace_path", None)
        if path:
            self._delete(path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    def _quietly_drop_all(self) -> None:
        try:
            self.drop_all()
        except Exception:  # the session has ended, and its folder with it
            pass
