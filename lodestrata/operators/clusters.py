"""Clusters of a similarity graph, and labels carried over to matched rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch_path


def token_graph(sets: DataFrame, key: str, token: str, least: float) -> DataFrame:
    """Edges (a, b), a < b, of sets whose Jaccard similarity is at least `least`; sets: distinct rows (key, token).

    Prefix filter: sets that similar share a token among the first n - ceil(least * n) + 1 of each in any one order of
    tokens. Rare tokens come first, so frequent ones are hardly ever join keys.
    """
    n = sets.groupBy(key).agg(F.count("*").alias("n"))
    df = sets.groupBy(token).agg(F.count("*").alias("df"))
    ranked = sets.join(df, token).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("df", F.col(token).alias("t")))).alias("all"))
    size = F.size("all")
    own = ranked.select(key, size.alias("n"), F.transform("all", lambda x: x.t).alias("tokens"), F.explode(F.transform(F.slice("all", F.lit(1), size - F.ceil(F.lit(least) * size - 1e-9).cast("int") + 1), lambda x: x.t)).alias("t"))
    side = lambda s: own.select("t", F.col(key).alias(s), F.col("n").alias(f"n_{s}"))
    near = side("a").join(side("b"), "t").where((F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(least) - 1e-9)).select("a", "b").distinct()
    whole = ranked.select(F.col(key).alias("k"), F.transform("all", lambda x: x.t).alias("tokens"))
    both = near.join(whole.select(F.col("k").alias("a"), F.col("tokens").alias("x")), "a").join(whole.select(F.col("k").alias("b"), F.col("tokens").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= F.lit(least) - 1e-9).select("a", "b")


def leader_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and cluster of every node: leaders in order of falling number of neighbours (then of name) take the neighbours
    that no earlier leader took. nodes: node; edges: (a, b), each once.

    Each round, all nodes that come before every undecided neighbour become leaders at once, which gives what going through
    them one by one gives. A node joins the first of its leaders. Rounds are written to the shared folder.
    """
    spark = nodes.sparkSession
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    ranked = nodes.join(degree, F.col("node") == F.col("a"), "left").select("node", (-F.coalesce("n", F.lit(0))).alias("rank"))

    def kept(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "clusters")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    both, left = kept(both), kept(ranked)
    order = kept(left)
    leaders = None
    while not left.isEmpty():
        around = both.join(left.select(F.col("node").alias("a")), "a").join(left.select(F.col("node").alias("b"), F.col("rank").alias("r")), "b")
        first = around.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("r", "b")).alias("m"))
        new = kept(left.join(first, "node", "left").where(F.col("m").isNull() | (F.struct("rank", "node") < F.struct(F.col("m.r"), F.col("m.b")))).select("node", "rank"))
        leaders = new if leaders is None else leaders.unionAll(new)
        taken = both.join(new.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).unionAll(new.select("node")).distinct()
        left = kept(left.join(taken, "node", "left_anti"))
    if leaders is None:
        return nodes.select("node", F.col("node").alias("cluster")).limit(0)
    own = leaders.select("node", F.col("node").alias("cluster"))
    near = both.join(leaders.select(F.col("node").alias("b"), "rank"), "b").groupBy(F.col("a").alias("node")).agg(F.min(F.struct("rank", "b")).alias("m")).select("node", F.col("m.b").alias("cluster"))
    return own.unionAll(order.select("node").join(near, "node").join(own.select("node"), "node", "left_anti"))


def attach_labels(matched: DataFrame, facts: DataFrame, key: str, source: str, tasks: Sequence[str], meta: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """key, the carried columns of facts, provenance, task, label and the columns of meta (task, ...) for each known label.

    provenance: the sources of a key in order, joined by `;`. Labels that are null are left out.
    """
    origin = matched.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), ";").alias("provenance"))
    long = facts.select(key, *carry, F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("int").alias("label")) for t in tasks])).alias("x")).select(key, *carry, "x.*").where("label is not null")
    return long.join(origin, key).join(meta, "task", "left")
