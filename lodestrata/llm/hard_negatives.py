"""Hard-negative mining: a distributed k-nearest join over Voronoi cells of norm-augmented vectors.

Scores are inner products of integer vectors. With M the largest norm, a row x gets one more component, sqrt(M^2 - |x|^2), and
an anchor q gets a zero: then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the highest scores are the nearest points and a band of
scores is a shell of distances. Pivots, picked by hash from the anchors, cut the space into Voronoi cells; anchors of one cell
form a group, in blocks of bounded size. By the triangle inequality a row can serve an anchor of the group at pivot p within
distance r only if its distance to p is at most d(q, p) + r, so a group asks for the rows within the largest such sum.

1. Rows meet the anchors of their own cell and label: that gives each anchor some 5th best score so far, hence a radius.
2. Rows go to the other groups of their label whose radius reaches them; both partial answers make the positives.
3. The positives set the band of scores of an anchor's negatives; rows go to the groups whose shell holds them.

Copies travel packed in chunks; a chunk meets a block of anchors by an equi-join on the group, each pair is a matrix product,
and only the best few of each anchor leave the task. No cell, group or label has to fit in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean, table, written

ANCHOR_EVERY = 100
POSITIVES = NEGATIVES = 5
LOWEST, HIGHEST = 80, 100
#: n anchors have 1 + sqrt(n) / PIVOT_STEP pivots; the pivots (and two radii each) are all that tasks are sent whole.
PIVOT_STEP = 4.0
MAX_PIVOTS = 4096
CHUNK_ROWS = BLOCK_ROWS = 1024
#: Rows that a packing task holds over all groups, and partial answers that a joining task holds, before they leave it.
HELD_ROWS = 1 << 15
HELD_ANSWERS = 1 << 18


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q (integer components), norm (its squared length), tie (a hash of label and q): the rows that take part.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part; nor do rows so long
    (a squared norm of 2^62 or more) that a score might not fit a long. Where vec_id is divisible by 7 the label is shifted.
    """
    e, scale = F.col("embedding"), F.lit(256.0)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    reach = F.aggregate(e, F.lit(0.0), lambda a, x: a + F.pow(F.abs(scale * x.cast("double")) + 1, F.lit(2.0)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(finite).where(reach < 2.0**62)
    own = own.select("vec_id", label.alias("label"), F.transform(e, lambda x: F.floor(scale * x.cast("double")).cast("long")).alias("q"))
    own = own.dropDuplicates(["vec_id", "label", "q"])
    return own.select("*", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm"), F.size("q").alias("dim"), F.xxhash64("label", "q").alias("tie"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: by Cauchy-Schwarz no partial sum passes the largest norms' product, so doubles serve below 2^53."""
    top = lambda m: float((m.astype(np.float64) ** 2).sum(1).max(initial=0))
    if top(a) * top(b) < 2.0**104:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Cells:
    """The pivots of vectors of one length, with the largest squared norm of the table."""

    def __init__(self, pivots: np.ndarray, top: int):
        self.pivots, self.top = pivots.astype(np.float64), float(top)
        self.rest = np.sqrt(np.maximum(self.top - (self.pivots**2).sum(1), 0))
        self.slack = 1e-6 * (math.sqrt(self.top) + 1)

    def distances(self, q: np.ndarray, augmented: bool) -> np.ndarray:
        """To every pivot, of rows (augmented) or of anchors."""
        x = q.astype(np.float64)
        norm = (x**2).sum(1)
        cross = x @ self.pivots.T
        if augmented:
            cross += np.sqrt(np.maximum(self.top - norm, 0))[:, None] * self.rest
            norm = np.full(len(x), self.top)
        return np.sqrt(np.maximum(norm[:, None] + self.top - 2 * cross, 0))

    def radius(self, norm: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance from an anchor at which rows of this score lie."""
        return np.sqrt(np.maximum(norm.astype(np.float64) + self.top - 2 * score.astype(np.float64), 0))


def first_best(who: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k entries of each `who` with the highest scores, ties by the smaller id."""
    order = np.lexsort((ids, -score, who))
    w = who[order]
    start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.zeros(0, np.int64)
    place = np.arange(len(w)) - np.repeat(start, np.diff(np.append(start, len(w))))
    return order[place < k]


def packed(rows: DataFrame, targets, by_label: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows packed in chunks for each group that targets(dim, q, norms) names as (row indices, pivots).

    Columns: dim, label (0 if the group is for all labels), pivot, ids, labels, q and `extra` as little-endian 64-bit numbers.
    """
    kinds = ["vec_id", "label", *extra]
    names = ["dim", "label", "pivot", *(f"b_{k}" for k in kinds), "b_q"]
    schema = "dim int, label long, pivot int, " + ", ".join(f"{n} binary" for n in names[3:])

    def run(batches):
        held: dict = {}
        rows_held = 0

        def out(keys):
            nonlocal rows_held
            parts = []
            for k in keys:
                got = held.pop(k)
                rows_held -= sum(len(x[0]) for x in got)
                parts.append([*k, *(np.concatenate([x[c] for x in got]).tobytes() for c in range(len(got[0])))])
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * (len(names) - 3)]
            for a in range(0, len(parts), 64):
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*parts[a : a + 64]), types)], names=names)

        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
                q, columns = matrix(part.column("q"), dim), [np.asarray(part.column(c), np.int64) for c in kinds]
                row, pivot = targets(dim, q, np.asarray(part.column("norm"), np.int64))
                label = columns[1][row] if by_label else np.zeros(len(row), np.int64)
                order = np.lexsort((pivot, label))
                row, pivot, label = row[order], pivot[order], label[order]
                cut = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (label[1:] != label[:-1])])) if len(row) else []
                for a, b in zip(cut, np.append(cut, len(row))[1:]):
                    for c in range(a, b, CHUNK_ROWS):
                        i = row[c : min(b, c + CHUNK_ROWS)]
                        key = (dim, int(label[a]), int(pivot[a]))
                        if key in held and sum(len(x[0]) for x in held[key]) + len(i) > CHUNK_ROWS:
                            yield from out([key])
                        held.setdefault(key, []).append([*(x[i] for x in columns), q[i]])
                        rows_held += len(i)
                if rows_held > HELD_ROWS:
                    yield from out(list(held))
        yield from out(list(held))

    return rows.select("dim", "norm", "q", *kinds).mapInArrow(lean(run), schema)


def blocks(anchors: DataFrame, cells: dict[int, Cells], n: int, by_label: bool, extra: tuple[str, ...]) -> DataFrame:
    """Anchors packed by the group of their nearest pivot (`pivot` is a column), dealt by group and a salt for large groups."""
    salt = F.pmod(F.col("tie"), F.lit(1 + n // (64 * BLOCK_ROWS)))
    dealt = anchors.repartition("dim", "pivot", *(["label"] if by_label else []), salt)
    where = lambda dim, q, norm: (np.arange(len(q)), cells[dim].distances(q, False).argmin(1))
    out = packed(dealt, where, by_label, ("tie", *extra))
    return out.select("dim", "label", "pivot", *(F.col(c).alias(f"a{c[1:]}") for c in out.columns if c.startswith("b_")))


def joined(chunks: DataFrame, anchors: DataFrame, answers, schema: str, keys: int) -> DataFrame:
    """Each chunk meets each block of its group; answers(block, chunk) gives arrays whose first `keys` and last two (score, id)
    are reduced to the best 5 of each key, in the task before they leave it."""
    names = [c.split()[0] for c in schema.split(", ")]

    def best(parts):
        cols = [np.concatenate(c) for c in zip(*parts)]
        order = np.lexsort(cols[:keys][::-1])
        same = np.ones(len(order), bool)
        for c in cols[:keys]:
            same[1:] &= c[order][1:] == c[order][:-1]
        same[:1] = False
        who = np.empty(len(order), np.int64)
        who[order] = np.cumsum(~same)
        keep = first_best(who, cols[-2], cols[-1], POSITIVES)
        return [c[keep] for c in cols]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                got = answers(row)
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size > HELD_ANSWERS:
                    held = [best(held)]
                    size = len(held[0][0])
                    if size > HELD_ANSWERS // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=names)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best(held)], names=names)

    return chunks.join(anchors, ["dim", "label", "pivot"]).mapInArrow(lean(run), schema)


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def positive_answers(row: dict) -> list[np.ndarray]:
    a_id, tie, ids = longs(row["a_vec_id"]), longs(row["a_tie"]), longs(row["b_vec_id"])
    s = products(longs(row["a_q"]).reshape(len(a_id), -1), longs(row["b_q"]).reshape(len(ids), -1))
    other = a_id[:, None] != ids
    if s.shape[1] > POSITIVES:
        bar = np.partition(np.where(other, s, np.iinfo(np.int64).min), -POSITIVES, axis=1)[:, -POSITIVES]
        other &= s >= bar[:, None]
    i, j = np.nonzero(other)
    keep = first_best(i, s[i, j], ids[j], POSITIVES)
    i, j = i[keep], j[keep]
    return [a_id[i], tie[i], s[i, j], ids[j]]


def negative_answers(row: dict) -> list[np.ndarray]:
    a_id, tie, a_label = longs(row["a_vec_id"]), longs(row["a_tie"]), longs(row["a_label"])
    ids, label = longs(row["b_vec_id"]), longs(row["b_label"])
    s = products(longs(row["a_q"]).reshape(len(a_id), -1), longs(row["b_q"]).reshape(len(ids), -1))
    high = np.stack([longs(row[f"a_p{k}"]) for k in range(POSITIVES)], 1)  # -1: none
    low = LOWEST * (high // HIGHEST) + -(-LOWEST * (high % HIGHEST) // HIGHEST)  # rounded up, without passing a long
    some = np.where(high >= 0, low, np.iinfo(np.int64).max).min(1)
    i, j = np.nonzero((s >= some[:, None]) & (s <= high.max(1)[:, None]) & (a_label[:, None] != label) & (a_id[:, None] != ids))
    score, out = s[i, j], []
    for k in range(POSITIVES):
        fits = np.flatnonzero((high[i, k] >= 0) & (score >= low[i, k]) & (score <= high[i, k]))
        keep = fits[first_best(i[fits], score[fits], ids[j[fits]], NEGATIVES)]
        out.append([a_id[i[keep]], tie[i[keep]], np.full(len(keep), k), score[keep], ids[j[keep]]])
    return [np.concatenate(c) for c in zip(*out)]


def mine(vectors: DataFrame, every: int = ANCHOR_EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label; rows that take no part: valid_rows. Anchors: ids divisible by `every`. Equal rows count
    once; rows of one id with other labels or vectors each count, but no row meets one of its own id. Vectors of different
    lengths do not meet. A positive whose score is negative has no negatives (no score lies between 80 and 100 percent of it);
    one whose score is 0 has those of score 0. Other columns are not read; an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = written(valid_rows(vectors), "hard-rows")
    anchors = rows.where(F.col("vec_id") % every == 0)
    # one row for each length of vector
    facts = {r.dim: r for r in rows.groupBy("dim").agg(F.max("norm").alias("top"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("n")).collect() if r.n}
    if not facts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    cells = {}
    for dim, r in facts.items():
        most = min(MAX_PIVOTS, 1 + int(math.sqrt(r.n) / PIVOT_STEP))
        picked = anchors.where(F.col("dim") == dim).groupBy("q").agg(F.xxhash64("q").alias("h")).orderBy("h").limit(most).collect()
        cells[dim] = Cells(np.array([x.q for x in picked], np.int64).reshape(len(picked), dim), r.top)
    n = sum(r.n for r in facts.values())
    rows = rows.where(F.col("dim").isin(list(facts)))

    def placed(batches):
        for batch in batches:
            dims, norm = np.asarray(batch.column("dim")), np.asarray(batch.column("norm"), np.int64)
            pivot, away = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            q, at = batch.column("q"), np.flatnonzero
            for dim in np.unique(dims).tolist():
                d = cells[dim].distances(matrix(q.filter(pa.array(dims == dim)), dim), False)
                i = at(dims == dim)
                pivot[i], away[i] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(pivot), pa.array(away)], names=[*own, "pivot", "away"])

    own = ["vec_id", "label", "q", "norm", "dim", "tie"]
    anchors = written(anchors.select(own).mapInArrow(lean(placed), "vec_id long, label long, q array<bigint>, norm long, dim int, tie long, pivot int, away double"), "hard-anchors")
    by_label = blocks(anchors, cells, n, True, ())
    home = lambda dim, q: cells[dim].distances(q, True)
    answer = "vec_id long, tie long, score long, id long"
    at_home = packed(rows, lambda dim, q, norm: (np.arange(len(q)), home(dim, q).argmin(1)), True)
    near = written(joined(at_home, by_label, positive_answers, answer, 2), "hard-near")

    best = Window.partitionBy("vec_id", "tie").orderBy(F.desc("score"), "id")
    fifth = near.withColumn("k", F.row_number().over(best)).where(F.col("k") == POSITIVES).select("vec_id", "tie", F.col("score").alias("low"))
    known = anchors.join(fifth, ["vec_id", "tie"], "left")
    reach = radii(known, cells, F.col("low"), None)

    def others(dim, q, norm):
        d = home(dim, q)
        wanted = d <= reach[dim][1] + cells[dim].slack
        wanted[np.arange(len(q)), d.argmin(1)] = False
        return np.nonzero(wanted)

    far = joined(packed(rows, others, True), by_label, positive_answers, answer, 2)
    positives = near.unionByName(far).withColumn("k", F.row_number().over(best)).where(F.col("k") <= POSITIVES)
    positives = written(positives.select("vec_id", "tie", (F.col("k") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hard-positives")

    slots = positives.where(F.col("positive_score") >= 0).groupBy("vec_id", "tie").agg(
        *(F.coalesce(F.max(F.when(F.col("slot") == k, F.col("positive_score"))), F.lit(-1)).alias(f"p{k}") for k in range(POSITIVES)),
        F.min("positive_score").alias("least"), F.max("positive_score").alias("most"),
    )
    banded = written(anchors.join(slots, ["vec_id", "tie"]), "hard-banded")
    shell = radii(banded, cells, F.expr(f"cast(ceil({LOWEST} * cast(least as decimal(20,0)) / {HIGHEST}) as long)"), F.col("most"))

    def in_shell(dim, q, norm):
        d = home(dim, q)
        return np.nonzero((d <= shell[dim][1] + cells[dim].slack) & (d >= shell[dim][0] - cells[dim].slack))

    groups = blocks(banded, cells, n, False, tuple(f"p{k}" for k in range(POSITIVES)))
    found = joined(packed(rows, in_shell, False), groups, negative_answers, "vec_id long, tie long, slot long, score long, id long", 3)
    rank = F.row_number().over(Window.partitionBy("vec_id", "tie", "slot").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES)
    return found.join(positives, ["vec_id", "tie", "slot"]).select(
        F.col("vec_id").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def radii(anchors: DataFrame, cells: dict[int, Cells], low, high) -> dict[int, np.ndarray]:
    """For each length of vector an array of two rows: the least and the largest distance from each pivot that its anchors ask
    for, given their lowest (null: any) and highest score (None: any). Pivots without anchors ask for nothing."""
    d2 = lambda score: F.sqrt(F.greatest(F.col("norm") + F.col("top") - 2 * score.cast("double"), F.lit(0.0)))
    tops = F.create_map(*(F.lit(x) for dim, c in cells.items() for x in (dim, c.top)))
    known = anchors.withColumn("top", tops[F.col("dim")])
    far = F.when(low.isNull(), F.lit(float("inf"))).otherwise(F.col("away") + d2(low))
    near = F.lit(0.0) if high is None else d2(high) - F.col("away")
    out = {dim: np.stack([np.full(len(c.pivots), np.inf), np.full(len(c.pivots), -np.inf)]) for dim, c in cells.items()}
    for r in known.groupBy("dim", "pivot").agg(F.min(near).alias("near"), F.max(far).alias("far")).collect():  # one row a pivot
        out[r.dim][:, r.pivot] = r.near, r.far
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH v0 AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND coalesce(list_sum(list_transform(embedding, lambda x: pow(abs(256 * x::DOUBLE) + 1, 2))), 0) < pow(2, 62)),
v AS (SELECT *, row_number() OVER () AS r FROM v0),
s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, b.r AS other,
    CASE WHEN len(a.q) = 0 THEN 0 ELSE list_inner_product(a.q, b.q) END::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT r, anchor_id, id AS positive_id, other, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id, other) <= {POSITIVES}),
n AS (
  SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {LOWEST}::HUGEINT * p.positive_score <= 100::HUGEINT * s.score AND 100::HUGEINT * s.score <= {HIGHEST}::HUGEINT * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
