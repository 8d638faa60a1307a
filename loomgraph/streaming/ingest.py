"""Facts from a stream of files (an extension: the batch surface re-reads whole trees).

Each micro-batch of new files is turned into facts and merged into a Parquet graph; facts
that came before, in this batch or an earlier one, are dropped by an anti-join with the
predicates the batch touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomgraph.api import build
from loomgraph.operators.analytics import graph


def append_facts(batch: DataFrame, path: str) -> None:
    spark = batch.sparkSession
    new = graph(build(batch))
    try:
        old = spark.read.schema("s string, o string, p string").parquet(path)
        new = new.join(old.select("s", "p", "o"), ["s", "p", "o"], "left_anti")
    except Exception as e:  # the first batch: there is no graph yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.repartition("p").write.mode("append").partitionBy("p").parquet(path)


def stream_facts(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that keeps the graph at ``path`` up to date with a streaming DataFrame of files."""
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append_facts(batch, path)).trigger(availableNow=True).start()
