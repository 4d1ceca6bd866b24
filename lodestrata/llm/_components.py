"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import shared_dir

#: Edges that one task contracts; a graph of more edges is contracted in parts and goes on in rounds.
LOCAL_EDGES = 1 << 20


def forest(batches):
    """Stars (u, v), v the smallest node, of the components of all edges (u, v) of a task."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        up = root.setdefault(x, x)
        while up != x:
            root[x] = x = root[up]
            up = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    pairs = np.array([(x, find(x)) for x in root], np.int64).reshape(-1, 2)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    for k in range(0, len(pairs), 1 << 16):
        part = pairs[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node it is joined to) of every node in the edges (a, b), both long.

    Tasks first contract their own edges to stars, LOCAL_EDGES or so each. Where that took more than one task, rounds follow:
    each joins every neighbour of a node to the smallest one around it, first those above the node, then those below, until
    only stars are left. Minima are combined before the shuffle, and joins may be split where a node has very many edges.
    Rounds are cut with checkpoint(), so a lost executor costs at most one round. No part of the graph goes to the driver.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    tasks = -(-now.count() // LOCAL_EDGES)
    if tasks:
        now = now.coalesce(tasks).mapInArrow(forest, "u long, v long").checkpoint()
    before = None
    while tasks > 1:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v")))
        now = small.where("u <> v").distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40)), F.max("u")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
