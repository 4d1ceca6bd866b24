"""Small frames with known answers."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import text as X
from lodestrata.functions import udfs as U
from lodestrata.operators import digests as D
from lodestrata.operators import inference as I
from lodestrata.operators import joins as J
from lodestrata.operators import labels as L
from lodestrata.operators import metrics as M
from lodestrata.operators import profile as P
from lodestrata.operators import splits as S
from lodestrata.operators.ordered import percentiles, prefix_sums
from lodestrata.sources import sinks
from lodestrata.sources import tables as T


def test_contradictions(spark):
    df = spark.createDataFrame([("k1", "a", 1), ("k1", "a", 0), ("k2", "a", 1), ("k2", "a", 1), ("k3", "a", None)], "k string, a string, label int")
    assert [tuple(r) for r in L.without_contradictions(df, ["k", "a"]).collect()] == [("k2", "a", 1)]


def test_potency_edges_and_priority(spark):
    df = spark.createDataFrame([(4.5, None), (4.5001, None), (5.4999, None), (5.5, None), (4.0, "active")], "v double, c string")
    label = L.priority_label([(F.col("c") == "active", 1), (F.col("v") >= 5.5, 1), (F.col("v") <= 4.5, 0)])
    assert [r[0] for r in df.select(label).collect()] == [0, None, None, 1, 1]
    assert [r[0] for r in df.select(L.potency_label(F.col("v"), 5.5, 4.5)).collect()] == [0, None, None, 1, 0]


def test_average_ranks(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (2,)], "v int")
    assert sorted((r.v, r.r) for r in df.select("v", M.average_rank([], F.col("v")).alias("r")).collect()) == [(1, 1.0), (2, 2.0), (3, 3.5), (3, 3.5)]


def test_calibration_has_empty_bins_and_the_last_takes_one(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.05)], "y int, p double")
    got = {r.bin: r.n for r in M.calibration(df, "y", "p", 4).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 1}


def test_holm(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert sorted((r.p, r.p_holm) for r in I.holm(df, "p").collect()) == [(0.01, 0.03), (0.03, 0.06), (0.04, 0.06)]


@pytest.mark.parametrize("pos,neg,p", [(0, 0, 1.0), (16, 7, 0.0931396484375), (23, 0, 2.384185791015625e-07)])
def test_sign_test(spark, pos, neg, p):
    got = spark.range(1).select(I.sign_p(F.lit(pos), F.lit(pos + neg))).first()[0]
    assert got == pytest.approx(p, rel=1e-12)


def test_wilcoxon_with_ties_and_zeros_against_all_sign_patterns(spark):
    from itertools import product

    d = [1.0, -1.0, 2.0, 3.0, 3.0, -0.5, 0.0, 4.0]
    got = I.wilcoxon(spark.createDataFrame([("g", x) for x in d], "g string, d double"), ["g"], "d").first()
    x = [v for v in d if v]
    order = sorted(abs(v) for v in x)
    rank = [sum(o < abs(v) for o in order) + (order.count(abs(v)) + 1) / 2 for v in x]
    plus = sum(r for r, v in zip(rank, x) if v > 0)
    low = min(plus, sum(rank) - plus)
    hits = sum(sum(r for r, s in zip(rank, signs) if s) <= low for signs in product((0, 1), repeat=len(x)))
    assert (got.n, got.w_plus) == (7, plus)
    assert got.p == pytest.approx(min(1, 2 * hits / 2 ** len(x)), abs=1e-9)


def test_wilcoxon_published_value(spark):
    # 23 untied pairs with W = 50
    ranks = list(range(1, 24))
    negative, left = set(), 50
    for r in reversed(ranks):
        if r <= left:
            negative.add(r)
            left -= r
    rows = [("g", float(-r if r in negative else r)) for r in ranks]
    assert I.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"], "d").first().p == pytest.approx(0.006032705307006836, abs=1e-9)


def test_greedy_split_lets_a_later_small_group_in(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 7), ("b", 2), ("c", 1)) for _ in range(n)], "g string")
    got = {r.g: r.part for r in S.greedy_split(df, "g", (0.8, 0.1), big_first=False).collect()}
    assert got == {"a": "train", "b": "test", "c": "train"}


@pytest.mark.parametrize("big_first", [True, False])
def test_greedy_split_by_runs_equals_one_after_the_other(spark, monkeypatch, big_first):
    rng = np.random.default_rng(3)
    sizes = {f"g{i}": int(n) for i, n in enumerate([*rng.geometric(0.2, 120), 90, 60])}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)] + [(None,)] * 3, "g string")
    whole = {r.g: (r.n, r.part) for r in S.greedy_split(df, "g", seed=5, big_first=big_first).collect()}
    total, used, want = sum(sizes.values()) + 3, {"train": 0, "valid": 0}, {}
    half = min(0.1, 1 - 0.8 - 0.1) * total / 2
    order = lambda g: ((whole[g][0] <= half) if big_first else -whole[g][0], "" if g is None else hashlib.md5(f"5|{g}".encode()).hexdigest())
    for g in sorted(whole, key=order):
        n = whole[g][0]
        part = "train" if used["train"] + n <= 0.8 * total else "valid" if used["valid"] + n <= 0.1 * total else "test"
        used[part] = used.get(part, 0) + n
        want[g] = (n, part)
    assert whole == want and {g: n for g, (n, _) in whole.items()} == sizes | {None: 3}
    monkeypatch.setattr(S, "FOLD_GROUPS", 3)
    assert {r.g: (r.n, r.part) for r in S.greedy_split(df, "g", seed=5, big_first=big_first).collect()} == want


def test_percentiles_by_parts(spark):
    rng = np.random.default_rng(8)
    rows = [(g, float(v)) for g, n in (("a", 501), ("b", 2), ("c", 1), (None, 40)) for v in rng.integers(0, 60, n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: (r.n, r.q) for r in percentiles(df, ["g"], "v", (0.05, 0.5, 0.95)).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, (n, q) in got.items():
        v = [x for k, x in rows if k == g and x is not None]
        assert n == len(v) and q == pytest.approx(np.quantile(v, [0.05, 0.5, 0.95]))
    none = percentiles(df.where("g = 'd'"), [], "v", (0.5,)).first()
    assert none.n is None and none.q == [None]


def test_hold_out_takes_at_least_one_group(spark):
    df = spark.createDataFrame([("a",)] * 9 + [("b",)], "g string")
    got = S.hold_out_groups(df, "g", 1, 0.15).collect()
    held = sum(r.n for r in got if r.held)
    assert held >= 2 or held == 9


def test_null_and_empty_keys_do_not_join(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "k")], "i int, k string")
    assert J.pairs_by_key(df, df.withColumnRenamed("i", "j"), "k").count() == 1
    assert L.without_members(df, df, ["k"]).where("i = 2").count() == 1


def test_sets(spark):
    empty, one = spark.createDataFrame([], "k int"), spark.createDataFrame([(1,)], "k int")
    r = S.compare_sets(empty, empty, ["k"]).first()
    assert (r.jaccard, r.coverage) == (1.0, None)
    assert S.compare_sets(one, one, ["k"]).first().jaccard == 1.0


def test_nearest_by_tokens_ties_and_no_match(spark):
    q = spark.createDataFrame([(1, "x"), (2, "none")], "query_id long, token string")
    c = spark.createDataFrame([(8, "x"), (9, "x")], "corpus_id long, token string")
    assert sorted((r.query_id, r.corpus_id, r.similarity) for r in J.nearest_by_tokens(q, c).collect()) == [(1, 8, 1.0), (2, None, 0.0)]


def test_nearest_by_cosine_ties_to_the_lowest_id(spark):
    v = spark.createDataFrame([(5, [1.0, 0.0]), (4, [2.0, 0.0]), (6, [0.0, 1.0])], "corpus_id long, vector array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    r = J.nearest_by_cosine(q, v, block=1).first()
    assert (r.corpus_id, r.similarity) == (4, 1.0)


def test_prefix_sums_over_many_partitions(spark):
    rows = [("big" if i % 3 else None, i % 50, i) for i in range(3000)] + [("one", 1, 5)]
    df = spark.createDataFrame(rows, "g string, k int, w int").repartition(7)
    own = df.groupBy("g", "k").agg(F.sum("w").alias("w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.g, r.k): r.u for r in prefix_sums(own, ["g"], [F.desc("k")], {"u": "w"}).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {(g, k): sum(w for h, j, w in rows if h == g and j > k) for g, k, _ in rows}
    assert prefix_sums(own.limit(0), ["g"], ["k"], {"u": "w"}).count() == 0


def test_spearman_by_counts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(a), float(a + b)) for g in ("x", None) for a, b in rng.integers(0, 9, (400, 2)).tolist()]
    df = spark.createDataFrame(rows + [("flat", 1.0, float(i)) for i in range(5)] + [("x", None, 1.0)], "g string, a double, b double")
    want = {}
    for g in ("x", None):
        a, b = (pd.Series([r[i] for r in rows if r[0] == g]).rank() for i in (1, 2))
        want[g] = (400, round(float(np.corrcoef(a, b)[0, 1]), 6))
    assert {r.g: (r.n, r.rho) for r in M.spearman(df, ["g"], "a", "b").collect()} == want | {"flat": (5, None)}


def test_one_class_group_has_no_auroc(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.1), ("b", 0, 0.1)], "g string, y int, p double")
    assert {r.g: r.auroc for r in M.auroc(df, ["g"], "y", "p").collect()} == {"a": None, "b": 0.5}


def test_validated_joins_fail_on_repeated_keys(spark):
    a, b = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeated key"):
        J.many_to_one(a, b, ["k"]).collect()
    assert J.one_to_one(b.limit(1), b.limit(1), ["k"]).columns == ["k", "v_a", "v_b"]


def test_grid_gaps(spark):
    o = spark.createDataFrame([(1, "a"), (2, "z")], "x int, y string")
    got = {(r.x, r.y): r.state for r in J.grid_gaps(o, [spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([("a",)], "y string")]).collect()}
    assert got == {(1, "a"): "present", (2, "a"): "missing", (2, "z"): "extra"}


def test_containing_pairs_without_inner_words(spark):
    t = spark.createDataFrame([(1, "one two three four"), (2, None)], "text_id long, text string")
    p = spark.createDataFrame([(1, "two three four"), (2, "ee fo"), (3, ""), (4, "nine")], "part_id long, part string")
    assert sorted((r.text_id, r.part_id) for r in J.containing_pairs(t, p).collect()) == [(1, 1), (1, 2)]


def test_summary_of_nothing(spark):
    r = P.summary(spark.createDataFrame([(float("nan"),), (None,)], "v double"), "v").first()
    assert (r.n, r.min, r.median, r.sd) == (0, None, None, None)


def test_digests(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "i int, v string")
    assert D.table_digest(df).first() == D.table_digest(df.orderBy(F.desc("i"))).first()
    assert D.table_digest(df).first() != D.table_digest(df.where("i < 3")).first()
    assert [r[0] for r in spark.createDataFrame([("a" * 64,), ("A" * 64,), (None,)], "t string").select(D.is_digest(F.col("t"))).collect()] == [True, False, False]


def test_text_functions(spark):
    df = spark.createDataFrame([("The  Cat, a (big) dog's",)], "t string")
    r = df.select(X.normalise_answer(F.col("t")).alias("a"), X.pretokens(F.col("t")).alias("p"), X.split_punctuation(F.col("t")).alias("s")).first()
    assert r.a == "cat big dogs"
    assert r.p == ["The", " ", " Cat", ",", " a", " (", "big", ")", " dog", "'s"]
    assert r.s[:3] == ["The", "Cat", ","]
    w = spark.range(1).select(X.windows(F.sequence(F.lit(1), F.lit(10)), 4, 1).alias("w")).first().w
    assert [(x.start, x.tokens) for x in w] == [(0, [1, 2, 3, 4]), (3, [4, 5, 6, 7]), (6, [7, 8, 9, 10])]
    pair = spark.range(1).select(X.truncate_pair(F.sequence(F.lit(1), F.lit(9)), F.sequence(F.lit(1), F.lit(4)), 6).alias("x")).first().x
    assert (len(pair.a) + len(pair.b), len(pair.a)) == (6, 3)
    assert spark.range(1).select(X.packed(F.array(*[F.lit(n).cast("long") for n in (3, 3, 5, 1)]), 6)).first()[0] == [0, 0, 1, 1]


def test_udfs(spark):
    df = spark.createDataFrame([("Crème brûlée", 1.0, 1.0 + 2**-52), (None, float("nan"), 1.0)], "t string, a double, b double")
    assert [r[0] for r in df.select(U.strip_accents()("t")).collect()] == ["Creme brulee", None]
    assert [r[0] for r in df.select(U.within_ulp()("a", "b")).collect()] == [True, False]
    assert U.merge_word("lower", (("e", "r"), ("l", "o"))) == ["lo", "w", "er"]
    with pytest.raises(ValueError):
        U.register("ngram-64")(lambda x: x)


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "cc"[: 1 + i % 2]) for i in range(10)], "i long, smiles string")
    sinks.write_shards(sinks.assign_shards(df, "i", val_size=3, shard_size=4), str(tmp_path / "s"), 4)
    assert T.shard_counts(spark.read.parquet(str(tmp_path / "s"))).first().n_rows == 10
    df.withColumnRenamed("smiles", "SMILES").write.parquet(str(tmp_path / "p"))
    assert T.read_shards(spark, str(tmp_path / "p"), "smiles").columns == ["smiles"]
    with pytest.raises(ValueError, match="missing"):
        T.read_shards(spark, str(tmp_path / "p"), "none")
    with pytest.raises(ValueError, match="cannot read"):
        T.read_any(spark, "x.pickle")
    (tmp_path / "l.csv").write_text("smiles,target\nCC,1\nCO,2\n")
    with pytest.raises(Exception, match="bad target"):
        T.read_labelled_csv(spark, str(tmp_path / "l.csv"), "smiles", "target", True).collect()
    assert T.read_labelled_csv(spark, str(tmp_path / "l.csv"), "smiles", "target", False).count() == 2
    sinks.write_once(df, str(tmp_path / "o"), "i")
    sinks.write_once(df, str(tmp_path / "o"), "i")
    with pytest.raises(RuntimeError):
        sinks.write_once(df.limit(3), str(tmp_path / "o"), "i")
    assert "| NA |" in sinks.markdown(spark.createDataFrame([(None, 1200)], "a int, b int"))
    assert T.file_digests(spark, str(tmp_path / "l.csv")).first().n_bytes == 24


def test_conll_and_ids(spark):
    lines = ["-DOCSTART- O", "", "EU B-ORG", "rejects O", "", "Peter B-PER"]
    got = T.conll(spark.createDataFrame(list(enumerate(lines)), "line long, value string")).orderBy("doc", "sentence", "place").collect()
    assert [(r.token, r.tag) for r in got] == [("EU", "B-ORG"), ("rejects", "O"), ("Peter", "B-PER")]
    assert got[0].sentence == got[1].sentence != got[2].sentence
    ids = spark.createDataFrame([(1, "a"), (2, " "), (3, "a")], "line long, value string")
    assert {r.problem: (r.n, r.first_lines) for r in T.checked_ids(ids).collect()} == {"blank": (1, [2]), "duplicate": (1, [3])}


def test_stream_goes_on_where_it_was(spark, tmp_path):
    from lodestrata.streaming import streams

    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    make = lambda a, b: spark.range(a, b).selectExpr("id", "timestamp'2024-01-01' + make_interval(0,0,0,0,0,cast(id as int),0) as ts", "'k' as k")
    make(0, 5).write.parquet(src)
    run = lambda: streams.drain(streams.first_seen(streams.file_stream(spark, src), ["id"], "ts", "1 day"), out, state)
    run()
    make(3, 8).write.mode("append").parquet(src)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    counts = streams.windowed_counts(streams.file_stream(spark, src), "ts", "k", "id", "1 minute", "2 minutes")
    streams.drain(counts, str(tmp_path / "w"), str(tmp_path / "ws"))
    assert spark.read.parquet(str(tmp_path / "w")).count() >= 1


def test_stream_dedup_of_many_files_out_of_time_order(spark, small, tmp_path):
    """50 part files, the latest events in the oldest files: several micro-batches, with copies days apart."""
    import os

    import pandas as pd

    from lodestrata.plans import catalogue

    folder = tmp_path / "events.parquet"
    folder.mkdir()
    events = pd.read_parquet(f"{small}/events.parquet").sort_values("ts", ascending=False)
    events["ts"] = events.ts.astype("datetime64[us]")
    size = -(-len(events) // 50)
    for i in range(50):
        part = pd.concat([events[i * size : (i + 1) * size], events[:3]])
        part.to_parquet(folder / f"part-{i:02}.parquet", index=False)
        os.utime(folder / f"part-{i:02}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    got = {r.event_type: r.n for r in catalogue.QUERIES["stream_file_dedup"](spark, str(tmp_path)).collect()}
    assert got == events.groupby("event_type").event_id.nunique().to_dict()


def test_label_matrix_holds_every_day(spark, small):
    from lodestrata.plans import build, catalogue

    want = L.without_contradictions(build.measurements(spark, small), build.KEYS).where("event_type in ('click', 'error', 'purchase')")
    got = catalogue.QUERIES["label_matrix_by_day"](spark, small)
    n = got.selectExpr("count(click) + count(error) + count(purchase) as n", "count(distinct day) as days").first()
    assert n.n == want.count() and n.days == 30


def test_positions_lose_no_row_however_wide(spark):
    from lodestrata.sources import sinks

    own = spark.range(200_000).select((F.col("id") * 7919 % 200_003).alias("k"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("payload"))
    got = sinks.with_position(own, "k")
    one = got.agg(F.count("*"), F.min("row_index"), F.max("row_index"), F.count_distinct("row_index"), F.sum(F.length("payload"))).first()
    assert tuple(one) == (200_000, 0, 199_999, 200_000, 200_000 * 256)
    dealt = sinks.assign_shards(own, "k", val_size=500, shard_size=1000)
    assert dealt.where("length(payload) > 0").count() == 200_000


def test_stream_of_many_files_out_of_order_keeps_all(spark, small, tmp_path):
    import os

    from lodestrata.plans.split_text import stream_file_dedup

    events = spark.read.parquet(f"{small}/events.parquet")
    where = tmp_path / "events.parquet"
    events.repartitionByRange(40, F.desc("ts")).write.option("maxRecordsPerFile", 25).parquet(str(where))
    for k, f in enumerate(sorted(where.glob("*.parquet"))):  # the latest events in the oldest files
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    got = {r.event_type: r.n for r in stream_file_dedup(spark, str(tmp_path)).collect()}
    assert got == {r.event_type: r.n for r in events.groupBy("event_type").agg(F.count_distinct("event_id").alias("n")).collect()}


def test_paired_bundle_is_its_parts(spark, small):
    from lodestrata.operators import inference as I
    from lodestrata.plans import measure, surfaces

    got = {r.contrast: r for r in surfaces.paired_bundle(spark, small).collect()}
    own = measure.differences(spark, small).groupBy("k", "s").pivot("g", ["A", "N", "R"]).agg(F.max("diff"))
    for pair, row in got.items():
        x, y = pair.split("-")
        one = own.dropna().select(F.lit("c").alias("c"), F.round(F.col(x) - F.col(y), 9).alias("d"))
        assert I.wilcoxon(one, ["c"], "d").first().p == row.p and row.p <= row.p_holm <= 1
    assert {r.friedman_p for r in got.values()} == {I.friedman3(own, ["A", "N", "R"]).first().p}


def test_pinned_files_and_single_files_refuse(spark, tmp_path):
    from lodestrata.sources import exports

    exports.single_file(spark.createDataFrame([("a",)], "value string"), str(tmp_path / "x" / "a.txt"), "text")
    with pytest.raises(Exception):
        exports.single_file(spark.createDataFrame([("b",)], "value string"), str(tmp_path / "x" / "a.txt"), "text")
    good = "87428fc522803d31065e7bce3cf03fe475096631e5e07bbd7a0fde60c4cf25c7"  # sha256 of "a" and a line end
    assert exports.pinned(spark, str(tmp_path / "x"), {"a.txt": good}, "*.txt").count() == 1
    with pytest.raises(Exception):
        exports.pinned(spark, str(tmp_path / "x"), {"a.txt": "0" * 64}, "*.txt").collect()
