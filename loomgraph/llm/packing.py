"""Filling fixed-capacity containers with items.

Method: cost-balanced packing.  An item of n tokens costs ``LINEAR * n + QUADRATIC *
n * n`` (the linear layers and the attention of a model).  Items are taken in
descending order, each goes to the container of lowest cost that still has room for
it; a container is opened beyond the least possible number only when none has room.
Where that needs more containers than taking the fullest one with room (of equally full
ones that of lowest cost), the second assignment stands: space comes before balance.
The corpus is dealt into groups of about ``GROUP`` items by a hash, each group is
packed on its own: a group has the size distribution of the whole, its leftover is a
fraction of one container, and no task ever holds more than a group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.bpe import encoder, read_vocabulary, vocabulary_path
from loomgraph.workspace import Workspace, spread

#: Items of a group.  A group's last container stays partly empty: at most one container of each group is lost.
GROUP = 8192
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``n_tokens`` (null for a null text, 0 for an empty one) of every row."""
    data = read_vocabulary(path or vocabulary_path())

    def count(batches):
        e = encoder(data)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if t is None else len(e.encode(t)) for t in b.column(1).to_pylist()], pa.int32())], names=["k", "n_tokens"])

    rows = documents.select(documents[key].alias("k"), documents[text].alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return spread(rows).mapInArrow(count, f"k {kind}, n_tokens int").withColumnRenamed("k", key)


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item; ``sizes`` are 1 to ``capacity``, in descending order."""
    balanced = lowest_cost(sizes, capacity)
    if len(sizes) == 0 or balanced.max() + 1 <= -(-int(sizes.sum()) // capacity):
        return balanced
    tight = least_room(sizes, capacity)
    return tight if tight.max() < balanced.max() else balanced


def least_room(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each item in the container with the least room that still takes it; of equal ones in that of lowest cost."""
    by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    some, opened = 0, 0  # bit r: there is a container with room r
    out = np.empty(len(sizes), np.int64)
    for k, n in enumerate(sizes.tolist()):
        if fits := some >> n:
            room = n + (fits & -fits).bit_length() - 1
            cost, i = heapq.heappop(by_room[room])
            if not by_room[room]:
                some &= ~(1 << room)
        else:
            room, cost, i = capacity, 0.0, opened
            opened += 1
        out[k] = i
        heapq.heappush(by_room[room - n], (cost + LINEAR * n + QUADRATIC * n * n, i))
        some |= 1 << (room - n)
    return out


def lowest_cost(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each item in the container of lowest cost that has room for it."""
    opened = int(-(-int(sizes.sum()) // capacity))
    left = [capacity] * opened
    ready = [(0.0, i) for i in range(opened)]  # by cost: those that may have room
    full: list[tuple[int, int, float]] = []  # by room: those that had too little for a larger item
    out = np.empty(len(sizes), np.int64)
    for k, n in enumerate(sizes.tolist()):
        while full and -full[0][0] >= n:
            _, i, cost = heapq.heappop(full)
            heapq.heappush(ready, (cost, i))
        while ready and left[ready[0][1]] < n:
            cost, i = heapq.heappop(ready)
            heapq.heappush(full, (-left[i], i, cost))
        if ready:
            cost, i = heapq.heappop(ready)
        else:
            cost, i = 0.0, len(left)
            left.append(capacity)
        out[k] = i
        left[i] -= n
        heapq.heappush(ready, (cost + LINEAR * n + QUADRATIC * n * n, i))
    return out


def pack(items: DataFrame, limits: list[tuple[int, int]], key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """limit_id, container_id, ``key``, part, first_token, n_tokens.

    ``limits`` are (limit_id, capacity) pairs, a few.  An item that fits is one row with
    part 0; a larger one is cut into parts of the full capacity and a rest.  Items of
    size 0 or null take no room: container_id is null, part 0.  Repeated keys are
    separate items.  Containers are numbered uniquely within a limit.
    """
    ws = Workspace(items.sparkSession)
    limit = F.explode(F.array(*[F.struct(F.lit(i).alias("limit_id"), F.lit(c).alias("capacity")) for i, c in limits])).alias("l")
    rows = items.select(items[key].alias("k"), items[size].cast("bigint").alias("n"))
    rows = ws.cut(rows.select("k", "n", limit).select("k", "n", "l.limit_id", "l.capacity"), "items")
    some = F.coalesce(F.col("n"), F.lit(0)) > 0
    parts = rows.filter(some).select(
        "limit_id", "capacity", "k", F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.col("capacity").cast("bigint"))).alias("part", "first"), "n"
    ).withColumn("n", F.least(F.col("n") - F.col("first"), F.col("capacity").cast("bigint")))
    total = parts.groupBy("limit_id").agg(F.ceil(F.count("*") / GROUP).alias("groups")).collect()  # one row a limit
    groups = F.lit(1)
    for r in total:
        groups = F.when(F.col("limit_id") == r["limit_id"], F.lit(r["groups"])).otherwise(groups)
    parts = parts.withColumn("g", F.pmod(F.xxhash64("k", "part", "limit_id"), groups))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k", "part"], ascending=[False, True, True], kind="stable")
        box = assign(pdf["n"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({"limit_id": pdf["limit_id"], "container_id": (pdf["g"].to_numpy() << 32) + box, "k": pdf["k"], "part": pdf["part"], "first": pdf["first"], "n": pdf["n"]})

    kind = rows.schema["k"].dataType.simpleString()
    packed = parts.groupBy("limit_id", "g").applyInPandas(one, f"limit_id int, container_id bigint, k {kind}, part int, first bigint, n bigint")
    none = rows.filter(~some).select("limit_id", F.lit(None).cast("bigint").alias("container_id"), "k", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("n"))
    return packed.unionByName(none).select("limit_id", "container_id", F.col("k").alias(key), "part", F.col("first").alias("first_token"), F.col("n").alias("n_tokens"))
