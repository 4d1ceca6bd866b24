"""Embedding near-dedup: an exact metric range join with pivots.

Vectors are scaled to length 1 and grouped by label (and length of the array). In each group pivots, picked by hash, cut the
sphere into cells of the nearest pivot. A neighbour of x within the angle of the threshold lies in the cell of pivot q only
if x is within that angle of the border between its own pivot p and q: by the triangle inequality on the sphere that is
x.(p - q) <= |p - q| * sin(angle). So x is copied into just the cells for which this holds, and every cell is joined on its
own: each vector finds all its neighbours in its home cell. Equal vectors are one node with a multiplicity. Large cells are
cut into chunks of home vectors, each a task's work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table, written
from ._components import components

THRESHOLD = 0.93
#: A group of m distinct vectors has 1 + log2(m) / PIVOT_STEP pivots, at most MAX_PIVOTS. Far-off vectors of many dimensions
#: border most cells, so each pivot more may cost a copy of each vector; large cells are cut into chunks.
PIVOT_STEP = 4.0
MAX_PIVOTS = 64
CHUNK_ROWS = 4096
BLOCK_ROWS = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, the largest component first, so that no square overflows or vanishes."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that can link: labelled, named, finite and not zero."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(e, lambda x: x != 0)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # + 0.0: a negative zero is the same number
    return own.where("vec_id is not null and label is not null and embedding is not null").where(finite & some).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))


def node_key() -> Column:
    """What names a node where its id may not: other labels or vectors may have the same."""
    return F.xxhash64("label", "embedding").alias("key")


def pivots(nodes: DataFrame) -> DataFrame:
    """label, dim, pivots (array of (number, vector)): at most MAX_PIVOTS a group, those of the smallest hashes."""
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("m"))
    want = sizes.select("label", "dim", F.least(F.lit(MAX_PIVOTS), 1 + F.floor(F.log2("m") / PIVOT_STEP)).alias("k"), F.col("m").alias("r"))
    # four times the wanted number is expected to pass the hash bar; the first by hash are taken, so the array stays short
    bar = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < (F.lit(1 << 30) * F.least(F.lit(1.0), 4 * (F.col("k") + 4) / F.col("r")))
    some = nodes.join(want, ["label", "dim"]).where(bar)
    return some.groupBy("label", "dim", "k").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("node").alias("h"), "embedding"))).alias("all")).select("label", "dim", F.slice("all", 1, F.greatest(F.col("k"), F.lit(1)).cast("int")).getField("embedding").alias("pivots"))


def placed(nodes: DataFrame, threshold: float) -> DataFrame:
    """label, dim, cell, home, node, m, embedding (unit, as bytes): each node in its home cell, and copies in cells it borders."""
    reach = math.sin(math.acos(threshold)) + 1e-9 if threshold > 0 else 2.0

    def run(batches):
        for batch in batches:
            cols = {n: [] for n in ("row", "cell", "home", "unit")}
            vectors, marks = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for row, (v, p) in enumerate(zip(vectors, marks)):
                x = unit(np.array([v]))
                if p is None or len(p) < 2:
                    cells, home = [0], 0
                else:
                    q = unit(np.array(p))
                    s = q @ x[0]
                    home = int(s.argmax())
                    gap = np.sqrt(np.maximum(((q - q[home]) ** 2).sum(1), 0))
                    cells = np.flatnonzero(s[home] - s <= reach * gap + 1e-9).tolist()
                for c in cells:
                    cols["row"].append(row)
                    cols["cell"].append(c)
                    cols["home"].append(c == home)
                    cols["unit"].append(x.tobytes())
            rows = batch.select([0, 1, 2, 3, 4]).take(pa.array(cols["row"], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cols["cell"], pa.int32()), pa.array(cols["home"], pa.bool_()), pa.array(cols["unit"], pa.binary())], names=["label", "dim", "node", "m", "key", "cell", "home", "unit"])

    marked = nodes.join(pivots(nodes), ["label", "dim"], "left").select("label", "dim", "node", "m", node_key(), "embedding", "pivots")
    return marked.mapInArrow(run, "label string, dim int, node long, m long, key long, cell int, home boolean, unit binary")


class Chunk:
    """The home vectors of one chunk of a cell, met by all vectors of the cell block by block."""

    def __init__(self, threshold: float):
        self.bar = threshold
        self.ids, self.units, self.keys = [], [], []
        self.a, self.b = [], []

    def add(self, ids: np.ndarray, units: list[bytes], keys: np.ndarray) -> None:
        self.ids += ids.tolist()
        self.units += units
        self.keys += keys.tolist()

    def close(self) -> None:
        self.ids = np.array(self.ids)
        self.home = np.stack([np.frombuffer(u) for u in self.units]).T
        self.count, self.root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))

    def meet(self, ids: np.ndarray, m: np.ndarray, units: list[bytes]) -> None:
        if isinstance(self.ids, list):
            self.close()
        near = np.stack([np.frombuffer(u) for u in units]) @ self.home >= self.bar
        self.count += m @ near
        for i in np.flatnonzero(near.any(1)).tolist():
            hit = np.flatnonzero(near[i])
            roots, at = np.unique(self.root[hit], return_index=True)
            if len(roots) > 1:  # one link to each part that was apart so far
                self.root[np.isin(self.root, roots)] = roots[0]
            for k in hit[at].tolist():
                if self.ids[k] != ids[i]:
                    self.a.append(int(ids[i]))
                    self.b.append(int(self.ids[k]))

    def rows(self) -> pa.RecordBatch:
        k, e = len(self.ids), len(self.a)
        return pa.RecordBatch.from_arrays([pa.array([*self.ids.tolist(), *self.a], pa.int64()), pa.array([*[None] * k, *self.b], pa.int64()), pa.array([*(self.count - 1).tolist(), *[None] * e], pa.int64()), pa.array([*self.keys, *[None] * e], pa.int64())], names=["a", "b", "n", "key"])


def cell_links(rows: DataFrame, threshold: float) -> DataFrame:
    """From placed rows: (a, null, n, key) the number of vectors that node a links to, by its key, since nodes of other labels or
    vectors may have the same id; and (a, b, null, null) links that join all that are linked."""

    def run(batches):
        last, chunk = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            node, m, units, own = np.asarray(batch.column(5)), np.asarray(batch.column(6)), batch.column(7).to_pylist(), np.asarray(batch.column(8))
            cut = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for s, e in zip(cut, cut[1:]):
                if e > s and keys[s][:4] != last:
                    if chunk is not None:
                        yield chunk.rows()
                    last, chunk = keys[s][:4], Chunk(threshold)
                if e > s and keys[s][4] == 0:
                    chunk.add(node[s:e], units[s:e], own[s:e])
                for k in range(s, e if e > s and keys[s][4] else s, BLOCK_ROWS):
                    chunk.meet(node[k : min(e, k + BLOCK_ROWS)], m[k : min(e, k + BLOCK_ROWS)], units[k : min(e, k + BLOCK_ROWS)])
        if chunk is not None:
            yield chunk.rows()

    sizes = rows.where("home").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("chunks"))
    spread = rows.join(sizes, ["label", "dim", "cell"])
    homes = spread.where("home").select("label", "dim", "cell", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk"), F.lit(0).alias("side"), "node", "m", "unit", "key")
    others = spread.select("label", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("side"), "node", "m", "unit", "key")
    key = ["label", "dim", "cell", "chunk"]
    return homes.unionAll(others).repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "a long, b long, n long, key long")


def link(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Rows link when their labels are equal, their arrays equally long and their cosine, in double precision, is at least
    the threshold. A row with a null id, label or array, a null, NaN or infinite component, or only zeros links with
    nothing: no links, its own id as component. Equal rows link with each other. Rows that share an id and a vector count
    as vectors of their own; rows that share an id are one vertex of the graph. Other columns are not read; an empty table
    gives an empty table.
    """
    good = valid_rows(vectors)
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"))
    nodes = written(nodes.select("label", F.size("embedding").alias("dim"), "node", "m", "embedding"), "vectors")
    found = written(cell_links(written(placed(nodes, threshold), "cells"), threshold), "links")
    joined = components(found.where("b is not null").select("a", "b"))
    # a node's vectors and, of the same id, any other vector: one name
    counts = found.where("b is null").groupBy("key").agg(F.max("n").alias("n"))
    info = nodes.select("label", "embedding", "node", node_key()).join(counts, "key").join(joined, "node", "left").select("label", "embedding", "n", F.coalesce("component", "node").alias("component_id"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("embedding"))
    out = own.join(info, ["label", "embedding"], "left").withColumn("n", F.when(F.col("vec_id").isNull(), None).otherwise(F.col("n")))
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component_id", "vec_id")))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= {THRESHOLD}),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = e.vec_id
"""
