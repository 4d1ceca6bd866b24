"""Plans that work by parts or in rounds, against brute force."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import features, text, udfs
from lodestrata.operators import inference, joins, metrics, splits, tasks
from lodestrata.plans import catalogue
from lodestrata.sources import tables


@pytest.mark.parametrize(("first", "fall"), [(0.5, 4.0), (0.9, 1.5), (0.05, 10.0)])
def test_nearest_by_tokens_equals_brute_force(spark, first, fall):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(6)]
    draw = lambda n: set(rng.sample(common, rng.randrange(1, 6))) | {f"w{int(rng.paretovariate(0.6)) % 60}" for _ in range(n)}
    q = {i: draw(rng.randrange(0, 12)) for i in range(40)} | {40: {"alone"}, 41: {"c0"}}
    c = {i: draw(rng.randrange(0, 25)) for i in range(150)} | {200: set(q[3]), 201: set(q[3])}
    frame = lambda sets, name: spark.createDataFrame([(i, t) for i, s in sets.items() for t in s], f"{name} long, token string").repartition(3)
    got = {r.query_id: (r.corpus_id, r.similarity) for r in joins.nearest_by_tokens(frame(q, "query_id"), frame(c, "corpus_id"), first, fall).collect()}
    assert set(got) == set(q)
    for i, s in q.items():
        best = max(((len(s & t) / len(s | t), -j) for j, t in c.items() if j != i), default=(0.0, 0))
        want = (-best[1], best[0]) if best[0] > 0 else (None, 0.0)
        assert got[i][0] == want[0] and math.isclose(got[i][1], want[1], abs_tol=1e-12), i


@pytest.mark.parametrize("big_first", [True, False])
def test_greedy_rounds_halve_the_room(spark, monkeypatch, big_first):
    """Sizes that make every large group just miss: the rounds stay few, the result is that of one group after the other."""
    sizes = [1 if i % 2 else 60 - i // 2 for i in range(90)]
    df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
    whole = {r.g: r.part for r in splits.greedy_split(df, "g", seed=None if not big_first else 3, big_first=big_first).collect()}
    monkeypatch.setattr(splits, "FOLD_GROUPS", 2)
    rounds = []
    paths = splits.scratch_path
    monkeypatch.setattr(splits, "scratch_path", lambda s, name: rounds.append(name) or paths(s, name))
    parts = {r.g: r.part for r in splits.greedy_split(df, "g", seed=None if not big_first else 3, big_first=big_first).collect()}
    assert parts == whole and len(whole) == 90
    assert rounds.count("fill") <= 2 * (math.log2(sum(sizes)) + 1)


def test_pair_accuracy_equals_all_pairs(spark):
    rng = random.Random(12)
    rows = [("ab"[rng.randrange(2)], rng.choice([0, 1, None]), rng.choice([None, 0.5, 0.5 + 1e-5, 0.5 + 2e-5, 0.50001, rng.random()])) for _ in range(300)] + [("c", 1, 0.3)]
    got = {r.g: (r.n_pairs, r.pair_accuracy) for r in metrics.pair_accuracy(spark.createDataFrame(rows, "g string, y int, s double").repartition(5), ["g"], "y", "s").collect()}
    for g in "abc":
        pos, neg = ([s for h, y, s in rows if h == g and y == k and s is not None] for k in (1, 0))
        points = [0.0 if n - p > 1e-5 else 1.0 if n <= p - 1e-5 * (1 + 1e-9) else 0.5 for p in pos for n in neg]
        assert got[g][0] == len(points) and (not points or math.isclose(got[g][1], np.mean(points), abs_tol=2e-6)), g
    assert got["c"][1] is None


def test_permutations_and_bootstraps_by_parts(spark):
    rng = np.random.Generator(np.random.PCG64(13))
    a = rng.integers(0, 9, 80).astype(float)
    b = a + rng.normal(size=80)
    units = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i long, a double, b double").repartition(3)
    rank = lambda x: np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    r = inference.permutation_spearman(units, "a", "b", 60, 5).first()
    assert math.isclose(r.rho, np.corrcoef(rank(a), rank(b))[0, 1], abs_tol=1e-6) and r.n_permutations == 60 and math.isclose(r.p, 1 / 61, abs_tol=1e-9)
    low_high = inference.bootstrap_spearman(units, "a", "b", 60, 5).first()
    assert low_high.n_finite == 60 and low_high.low < r.rho < low_high.high


@pytest.fixture
def small_broadcasts(spark):
    """Tables that Spark takes for small are broadcast, but a broadcast beyond 40 MB fails, as it would for want of driver memory."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "256k", "spark.sql.maxBroadcastTableSize": "40m"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def drawn(seed, replicate, n):
    return np.array([int(hashlib.md5(f"{seed}|{replicate}|{i}".encode()).hexdigest()[:7], 16) % n for i in range(n)])


def test_bootstrap_mean_of_many_units(spark, small_broadcasts, tmp_path):
    v = np.round(np.random.Generator(np.random.PCG64(17)).normal(50, 9, 20_000), 4)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").write.parquet(str(tmp_path / "units"))
    units = spark.read.parquet(str(tmp_path / "units"))
    low, high = np.quantile([v[drawn(5, r, len(v))].mean() for r in range(100)], [0.025, 0.975])
    got = inference.bootstrap_mean(units, "v", 100, 5).first()
    assert got.n == len(v) and np.allclose([got.mean, got.low, got.high], [v.mean(), low, high], rtol=0, atol=2e-6)
    assert inference.bootstrap_mean(units.where("i < 0"), "v", 100, 5).collect() == [(0, None, None, None)]


def test_bootstrap_spearman_of_many_units(spark, small_broadcasts, tmp_path):
    rng = np.random.Generator(np.random.PCG64(18))
    a = np.round(rng.normal(size=20_000), 4)
    b = np.floor(4 * (a + rng.normal(size=len(a))))
    spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "i long, a double, b double").write.parquet(str(tmp_path / "units"))
    rank = lambda x: pd.Series(x).rank().to_numpy()
    low, high = np.quantile([np.corrcoef(rank(a[d]), rank(b[d]))[0, 1] for d in (drawn(5, r, len(a)) for r in range(100))], [0.025, 0.975])
    got = inference.bootstrap_spearman(spark.read.parquet(str(tmp_path / "units")), "a", "b", 100, 5).first()
    assert got.n_finite == 100 and np.allclose([got.low, got.high], [low, high], rtol=0, atol=2e-6)


def test_endpoint_record_of_many_units(spark, small_broadcasts, tmp_path):
    v = np.round(np.random.Generator(np.random.PCG64(19)).normal(0.01, 1, 20_000), 2)
    spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, z double").write.parquet(str(tmp_path / "units"))
    low, high = np.quantile([v[drawn(7, r, len(v))].mean() for r in range(100)], [0.025, 0.975])
    got = inference.endpoint_record(spark.read.parquet(str(tmp_path / "units")), "z", 100, 7).drop("p").first()
    assert (got.n, got.n_pos, got.n_neg) == (len(v), (v > 0).sum(), (v < 0).sum())
    assert np.allclose([got.mean, got.low, got.high, got.median], [v.mean(), low, high, np.median(v)], rtol=0, atol=2e-6)


def test_containing_pairs_by_pairs_of_words(spark):
    rng = random.Random(14)
    words = ["the", "the", "of", "a", "bc", "d"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + ["", None, "the  of a", "xthe ofx"]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(40)] + ["", None, "e o", " the ", "he of a b", "the  of"]
    own = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    for some in (parts, [p for p in parts if p and len(p.split()) > 3], ["x the y", "the of a"]):
        known = spark.createDataFrame(list(enumerate(some)), "part_id long, part string")
        got = sorted((r.text_id, r.part_id) for r in joins.containing_pairs(own, known).collect())
        assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(some) if t is not None and p and p in t)


def test_keys_of_ones_own(spark):
    df = spark.createDataFrame([("a1-b2",), ("",), (None,), ("bad",)], "t string")
    keys = {"whole": lambda c: c, "first": lambda c: F.when(c != "bad", F.substring(c, 1, 1))}
    got = [r.k.asDict() for r in df.select(features.key_set(F.col("t"), F.col("t"), keys).alias("k")).collect()]
    assert got == [{"whole": "a1-b2", "first": "a", "status": "ok"}, {"whole": "", "first": "", "status": "empty"}, {"whole": None, "first": None, "status": "missing"}, {"whole": "bad", "first": None, "status": "failed"}]


def test_nearest_by_cosine_equals_brute_force(spark):
    rng = np.random.Generator(np.random.PCG64(15))
    vectors = rng.normal(size=(400, 6))
    vectors[50:60] = vectors[40:50] * 3  # ties: same direction
    kinds = [None if i % 97 == 0 else "ab"[i % 2] for i in range(400)]
    rows = [(i, None if i % 89 == 5 else v.tolist() if i % 61 else v[:3].tolist(), k) for i, (v, k) in enumerate(zip(vectors, kinds))] + [(500, [], "a"), (None, [1.0] * 6, "a")]
    df = spark.createDataFrame(rows, "id long, vector array<double>, kind string").repartition(7)
    q, c = df.where("id % 5 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "corpus_id")
    for equal in ([], ["kind"]):
        got = {r.query_id: (r.corpus_id, r.similarity) for r in joins.nearest_by_cosine(q, c, equal, block=16, copies=3).collect()}
        known = [(i, np.array(v), k) for i, v, k in rows if i is not None and v and (k is not None or not equal)]
        want = {}
        for i, v, k in known:
            if i % 5 == 0:
                met = [(round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), -j) for j, w, h in known if j != i and len(w) == len(v) and (not equal or h == k)]
                if met:
                    want[i] = max(met)
        assert set(got) == set(want)
        for i, (s, j) in want.items():
            assert math.isclose(got[i][1], s, abs_tol=1e-9)


def test_folds_and_splits(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 9 else None) for i in range(10)], "i int, fold int")
    train, valid = splits.fold_parts(df, "fold", 1)
    assert train.columns == valid.columns == ["i"] and {r.i for r in valid.collect()} == {1, 4, 7} and train.count() == 6
    own = spark.createDataFrame([("train", True), ("train", None), ("test", True)], "s string, v boolean")
    assert [r.partition for r in own.select(splits.split_partition(F.col("s"), F.col("v"))).collect()] == ["valid", "train", "test"]
    with pytest.raises(Exception, match="unknown split: other"):
        spark.createDataFrame([("other", True)], "s string, v boolean").select(splits.split_partition(F.col("s"), F.col("v"))).collect()


def test_task_registry(spark, tmp_path, monkeypatch, caplog):
    r = tasks.TaskRegistry()
    r.register("Count")(lambda df: df.agg(F.count("*").alias("value")))
    r.register("most", "the largest")(lambda df: df.agg(F.max("id").alias("value")))
    with pytest.raises(ValueError, match="registered already"):
        r.register("COUNT")(lambda df: df)
    assert {(x.task, x.value) for x in r.run_all(spark.range(7)).collect()} == {("count", 7), ("most", 6)}
    r.register("count", replace=True)(lambda df: df.agg((F.count("*") + 1).alias("value")))
    assert "registered again" in caplog.text and r.run("Count", spark.range(7)).first().value == 8
    with pytest.raises(KeyError, match="no task none"):
        r.run("none", spark.range(1))
    (tmp_path / "plugs_for_test").mkdir()
    (tmp_path / "plugs_for_test" / "__init__.py").write_text("found = []\n")
    (tmp_path / "plugs_for_test" / "a.py").write_text("from plugs_for_test import found\nfound.append('a')\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert r.load("plugs_for_test") == ["a"] and __import__("plugs_for_test").found == ["a"]


def test_scorers_by_suffix(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"features": ["length", "words"], "weights": [2.0, -1.0], "bias": 0.5}')
    df = spark.createDataFrame([("ab cd",), ("",)], "t string")
    assert [r.x for r in df.select(udfs.scorer(str(tmp_path / "m.json"), False)("t").alias("x")).collect()] == [8.5, 0.5]
    assert [r.x for r in df.select(udfs.scorer(f"file:{tmp_path}/m.json", False, 1.0, 2.0)("t").alias("x")).collect()] == [18.0, 2.0]
    with pytest.raises(ValueError, match="no scorer for .pt"):
        udfs.scorer("m.pt", False)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://Example.ORG:80/A/b/?q=1#top", "http://example.org/A/b/?q=1"), ("https://u:p@Host:443/x/", "https://host/x"), ("https://host:8443", "https://host:8443"), ("ftp://h:80/", "ftp://h:80"),
        ("example.org/x", None), ("http:///x", None), ("", None), (None, None), ("  http://h/ ", "http://h"),
    ],
)
def test_canonical_urls(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(text.canonical_url(F.col("u")).alias("k")).first().k == key


def test_chunks_of_files(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(str(tmp_path / "p"))
    got = tables.read_chunks(spark, str(tmp_path / "p"), 10).groupBy("file", "chunk").agg(F.count("*").alias("n"), F.min("row_in_file").alias("a"), F.max("row_in_file").alias("b")).collect()
    assert sum(r.n for r in got) == 100 and all(r.a == 10 * r.chunk and r.b == r.a + r.n - 1 and r.n <= 10 for r in got)


def test_chunks_run_on_over_files(spark, tmp_path):
    """Files of any size and order, a document without text and some without id."""
    rng = random.Random(20)
    ids = rng.sample(range(1000), 400)
    rows = [(i, None if i == ids[7] else "x" * rng.randrange(90)) for i in ids] + [(None, "four")] * 3
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT chunk, n_rows, first_id, last_id, n_chars FROM ({catalogue.SQL['chunk_stream']}) ORDER BY 1").fetchall()
    got = catalogue.QUERIES["chunk_stream"](spark, str(tmp_path)).select("chunk", "n_rows", "first_id", "last_id", "n_chars")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 7


def test_grids_of_many_values(spark):
    rng = random.Random(16)
    a, b, c = [None, *range(6)], ["x", "y", None], [1, 2]
    observed = [(i, j, k) for i in a for j in b for k in c if i in (0, 3) or rng.random() < 0.6] + [(9, "x", 1), (1, "z", 1), (1, "x", 7)] * 2
    frame = lambda values, name: spark.createDataFrame([(v,) for v in values] * 2, name)
    got = joins.grid_gaps(spark.createDataFrame(observed, "i int, j string, k int"), [frame(a, "i int"), frame(b, "j string"), frame(c, "k int")]).collect()
    grid = {(i, j, k) for i in a for j in b for k in c}
    want = {x: "present" if x in grid else "extra" for x in observed} | {x: "missing" for x in grid - set(observed)}
    assert len(got) == len(want) and {(r.i, r.j, r.k): r.state for r in got} == want


def test_scratch_goes_with_its_scope(spark, tmp_path):
    from lodestrata.sources import shared, sinks

    df = spark.range(20).repartition(3)
    before = list(shared._scratch)
    with shared.scratch_scope():
        sinks.with_position(df, "id").write.parquet(str(tmp_path / "kept"))
        made = [p for _, p in shared._scratch if p not in {q for _, q in before}]
        with shared.scratch_scope():
            sinks.with_position(df, "id").count()
            assert len(shared._scratch) > len(before) + len(made)
        assert len(shared._scratch) == len(before) + len(made) and made
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert shared._scratch == before and not any(exists(p) for p in made) and spark.read.parquet(str(tmp_path / "kept")).count() == 20
