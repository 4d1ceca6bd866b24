"""Spans, windows, masks, byte pieces, block files, matrices, result files, digests, generators and states on hand-made rows."""

import hashlib
import json
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import features, generators, text, udfs
from lodestrata.operators import digests, spans, states
from lodestrata.sources import matrix, results, sinks
from lodestrata.sources import tables as T
from lodestrata.streaming import streams


def one(spark, column, **values):
    names = ", ".join(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kind(v)}" for n, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x, names


def kind(v):
    return "array<boolean>" if isinstance(v, list) and (not v or isinstance(v[0], bool) or v[0] is None) else "array<string>" if isinstance(v, list) else "long" if isinstance(v, int) else "string"


# spans


def test_contained_equals_brute_force(spark):
    rng = random.Random(2)
    s = [(rng.randrange(3), a := rng.randrange(90), a + rng.randrange(0, 40)) for _ in range(200)] + [(0, None, 3), (0, 3, None), (None, 1, 2)]
    w = [(rng.randrange(3), a := rng.randrange(90), a + rng.randrange(0, 50)) for _ in range(60)]
    own = spark.createDataFrame(list(dict.fromkeys(s)), "k long, start long, end long")
    held = spark.createDataFrame(list(dict.fromkeys(w)), "k long, w_start long, w_end long")
    for width in (1, 7, 500):
        got = spans.contained(own, held, ["k"], width)
        want = {(k, a, b, c, d) for k, a, b in s for q, c, d in w if k == q and None not in (k, a, b) and a < b and c <= a and b <= d}
        assert sorted((r.k, r.start, r.end, r.w_start, r.w_end) for r in got.collect()) == sorted(want)
    left = spans.left_out(own.where("k is not null and start < end"), got, ["k"]).count()
    assert left == len({(k, a, b) for k, a, b in s if None not in (k, a, b) and a < b} - {x[:3] for x in want})
    rows = spans.windows_with_spans(held, got, ["k"]).collect()
    assert len(rows) == len(set(w)) and sum(len(r.spans) for r in rows) == len(want)


@pytest.mark.parametrize(("n", "want"), [(0, [(0, 0)]), (5, [(0, 5)]), (8, [(0, 8)]), (9, [(0, 8), (6, 9)]), (20, [(0, 8), (6, 14), (12, 20), (18, 20)])])
def test_covering_windows(spark, n, want):
    assert [tuple(x) for x in one(spark, text.covering_windows(F.col("n"), 8, 2), n=n)[0]] == want


@pytest.mark.parametrize("flags", [[], [True], [False], [True, True, None, True], [None, False, True, True, False, True]])
def test_runs(spark, flags):
    want, i = [], 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j > i:
            want.append((i, j))
        i = max(j, i + 1)
    assert [tuple(x) for x in one(spark, text.runs(F.col("f")), f=flags)[0]] == want


def test_token_spans_hold_their_characters(spark):
    tokens = ["ab", "c", " ", "défg", ""]
    ends = one(spark, text.token_ends(F.col("t")), t=tokens)[0]
    assert ends == [2, 3, 4, 8, 8]
    for s in range(8):
        for e in range(s, 9):
            a, b = one(spark, text.token_span(F.array(*map(F.lit, ends)), F.lit(s), F.lit(e)))[0]
            joined = sum(map(len, tokens[:a]))
            assert joined <= s and sum(map(len, tokens[:b])) >= max(e, s + 1) and (a == 0 or sum(map(len, tokens[: a + 1])) > s)


# cuts, buckets, padding, hops


def test_random_ends_of_pairs(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(5)]
    fronts = set()
    for key in range(12):
        x = one(spark, text.truncate_pair(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), 8, F.lit(key), 3))[0]
        assert len(x.a) == len(x.b) == 4
        assert "".join(x.a) in "".join(a) and "".join(x.b) in "".join(b)
        fronts.add(x.a[0])
    assert len(fronts) > 2
    x = one(spark, text.truncate_pair(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), 8))[0]
    assert x.a == a[:4] and x.b == b[:4]


def test_buckets_are_clamped(spark):
    rows = spark.createDataFrame([(x,) for x in (-10_000, -500, -99, -3, 0, 4, 98, 99, 100, 500, 10_000)], "x long").select("x", text.log_bucket(F.col("x"), 8, 100).alias("b")).collect()
    got = {r.x: r.b for r in rows}
    assert got[99] == got[100] == got[500] == got[10_000] == 7 and got[-99] == got[-500] == got[-10_000] == -7 and (got[-3], got[0], got[4]) == (-3, 0, 4)


def test_hop_distances_of_any_length(spark):
    edges = [(0, i, i + 1) for i in range(19)] + [(1, i, (i + 1) % 9) for i in range(9)] + [(1, 20, 21), (1, 21, 21), (0, None, 3)]
    df = spark.createDataFrame(edges, "g int, i int, j int")
    near = {}
    for g, a, b in edges:
        if a is not None and a != b:
            near.setdefault((g, a), set()).add(b)
            near.setdefault((g, b), set()).add(a)
    want = {}
    for g, a in near:
        queue, seen = deque([a]), {a: 0}
        while queue:
            x = queue.popleft()
            for y in near[g, x]:
                if y not in seen:
                    seen[y] = seen[x] + 1
                    queue.append(y)
        want |= {(g, a, b): d for b, d in seen.items()}
    assert {(r.g, r.i, r.j): r.d for r in features.hop_distances(df, ["g"]).collect()} == want
    assert {(r.g, r.i, r.j): r.d for r in features.hop_distances(df, ["g"], 5).collect()} == {k: d for k, d in want.items() if d <= 5}


def test_padding_to_the_longest_of_a_batch(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, None), (3, [5, 6]), (4, [])], "k int, v array<int>")
    got = {r.k: (r.v, r["mask"]) for r in features.padded_batches(df, "v", F.col("k") < 3, 0).collect()}
    assert got == {0: ([1, 2, 3], [1, 1, 1]), 1: ([4, 0, 0], [1, 0, 0]), 2: ([0, 0, 0], [0, 0, 0]), 3: ([5, 6], [1, 1]), 4: ([0, 0], [0, 0])}


# byte pieces and masks


def test_byte_letters_round_trip(spark):
    for t in ("", "plain", "é ü 字 😀", "\n\t\x00\x7f\xa0\xad", "don't"):
        letters, _ = one(spark, text.byte_letters(F.lit(t)))
        assert len(letters) == len(t.encode()) and not any(c.isspace() for c in letters)
        assert one(spark, text.letters_text(F.lit(letters)))[0] == t
    hidden, shown = text.byte_table()
    assert len(set(shown)) == len(hidden) == 68 and not set(shown) & {chr(b) for b in range(256)}


def test_byte_pieces_equal_the_merge_loop(spark):
    from lodestrata.plans.sequences import MERGES

    rng = random.Random(5)
    texts = ["", "the then other", "aaaa  the", "é then\nthe"] + ["".join(rng.choice("thean orsingdé ") for _ in range(rng.randrange(50))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.byte_pieces(F.col("t"), MERGES).alias("p"), F.transform(text.pretokens(F.col("t")), text.byte_letters).alias("w"))
    for r in df.collect():
        assert r.p == [x for w in r.w for x in udfs.merge_word(w, tuple(MERGES))]


def test_masked_tokens(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate((0, 1, 5, 6, 7, 100, 5000))], "k long, n int")
    rows = df.select("k", "n", text.masked_tokens(F.col("n"), F.col("k"), 0.15, 3, 1).alias("m"), text.span_masks(F.col("n"), F.col("k"), 0.15, 3, 1).alias("s")).collect()
    for r in rows:
        at = [x.position for x in r.m]
        assert at == sorted(set(at)) and all(0 <= x < r.n for x in at) and len(at) <= max(1, round(r.n * 0.15))
        assert all(1 <= x.end - x.start <= 3 for x in r.s) and all(x.end <= y.start for x, y in zip(r.s, r.s[1:]))
    kinds = [x.kind for x in rows[-1].m]
    assert len(kinds) > 500 and 0.7 < kinds.count("mask") / len(kinds) < 0.9 and kinds.count("keep") and kinds.count("random")


# block files


def parsed(lines):
    """(doc, sentence, place, token, tag) by hand."""
    out, doc, sent = [], [], []
    docs = []
    for line in [*lines, "-DOCSTART- x"]:
        if line.startswith("-DOCSTART-"):
            doc += [sent] if sent else []
            docs += [doc] if doc else []
            doc, sent = [], []
        elif not line.strip(" "):
            doc += [sent] if sent else []
            sent = []
        else:
            f = line.rstrip(" ").split(" ")
            sent.append((f[0], f[-1]))
    for i, d in enumerate(docs):
        for j, s in enumerate(d):
            out += [(i, j, k, *x) for k, x in enumerate(s)]
    return out


def test_conll_files_in_many_splits(spark, tmp_path):
    rng = random.Random(6)
    want = []
    (tmp_path / "in").mkdir()
    for f in range(3):
        lines = [rng.choice(["-DOCSTART- -X- O", "", "", "tok O", "Émile B-PER x", "a b c d", "  "]) for _ in range(400)] if f else ["", "-DOCSTART-", "", "only O"]
        (tmp_path / "in" / f"{f}.txt").write_text("\n".join(lines) + "\n")
        want += [(f"{f}.txt", *x) for x in parsed(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        rows = T.read_conll(spark, str(tmp_path / "in"))
        got = sorted((r.file.rsplit("/", 1)[1], r.doc, r.sentence, r.place, r.token, r.tag) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted(want)


def test_conll_written_and_read(spark, tmp_path):
    rows = [(d, s, p, f"t{d}.{s}.{p}", "O") for d in (7, 9) for s in (2, 5) for p in range(3)]
    df = spark.createDataFrame(rows, "d int, s int, p int, t string, tag string")
    sinks.write_conll(df, str(tmp_path / "c"), "d", "s", "p", ["t", "tag"])
    got = T.read_conll(spark, str(tmp_path / "c")).groupBy("file", "doc", "sentence").agg(F.sort_array(F.collect_list("token")).alias("t")).collect()
    assert sorted(r.t for r in got) == sorted([f"t{d}.{s}.{p}" for p in range(3)] for d in (7, 9) for s in (2, 5))
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sinks.write_conll(df, str(tmp_path / "c"), "d", "s", "p", ["t"])


# matrices


def test_matrix_file_of_another_program(spark, tmp_path):
    m = np.arange(60, dtype=np.float16).reshape(20, 3)
    m[4, 1] = np.nan
    np.save(tmp_path / "m.npy", m)
    df = matrix.read_matrix(spark, str(tmp_path / "m.npy"), 24)
    assert df.rdd.getNumPartitions() == 5
    got = np.array([r["values"] for r in df.orderBy("row").collect()])
    assert np.array_equal(got, m.astype(float), equal_nan=True)


@pytest.mark.parametrize(
    ("value", "message"),
    [(np.zeros(3), "two dimensions"), (np.zeros((2, 0)), "no dimension may be 0"), (np.array([["a", "b"]]), "bool, integer or floating"), (np.asfortranarray(np.ones((3, 4))), "column order")],
)
def test_unfit_matrices_fail_before_any_task(spark, tmp_path, value, message):
    np.save(tmp_path / "m.npy", value)
    with pytest.raises(Exception, match=message):
        matrix.read_matrix(spark, str(tmp_path / "m.npy")).explain()
        matrix.read_matrix(spark, str(tmp_path / "m.npy")).collect()


def test_cut_matrix_is_refused(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.ones((5, 5)))
    raw = (tmp_path / "m.npy").read_bytes()
    (tmp_path / "m.npy").write_bytes(raw[:-8])
    with pytest.raises(Exception, match="do not hold"):
        matrix.read_matrix(spark, str(tmp_path / "m.npy")).collect()


def test_matrix_folder(spark, tmp_path):
    rows = [(i, [float(i), None, -1.5]) for i in range(50)]
    df = spark.createDataFrame(rows, "row long, v array<double>").repartition(7)
    matrix.write_matrix(df, str(tmp_path / "a"), values="v", dtype="float16")
    got = matrix.read_matrix(spark, str(tmp_path / "a")).orderBy("row").collect()
    assert [r.row for r in got] == list(range(50)) and got[7]["values"][0] == 7.0 and np.isnan(got[7]["values"][1])
    assert json.loads((tmp_path / "a" / "matrix.json").read_text())["shape"] == [50, 3]
    for name, bad, kind_ in (("gap", df.where("row <> 9"), "float32"), ("wide", df.withColumn("v", F.array(F.lit(1e9))), "float16"), ("null", df, "int8"), ("ragged", df.withColumn("v", F.slice("v", F.lit(1), F.least(F.col("row").cast("int") + 1, F.lit(3)))), "float32")):
        with pytest.raises(Exception):  # noqa: B017
            matrix.write_matrix(bad, str(tmp_path / name), values="v", dtype=kind_)
        assert not (tmp_path / name / "matrix.json").exists()
    with pytest.raises(Exception, match="FileExists"):
        matrix.write_matrix(df, str(tmp_path / "a"), values="v")


# result files


def result_file(folder, name, **change):
    one_ = {"task": name, "task_type": "regression", "primary_metric": "mae", "ckpt": "c1", "pretrained": {"test_mae_mean": 1.5, "test_mae_std": 0.1, "val_mae_mean": 1.0, "val_mae_std": 0.2, "n_seeds": 3}}
    folder.mkdir(exist_ok=True)
    (folder / f"results_{name}.json").write_text(json.dumps(one_ | change, indent=1))


def test_result_files(spark, tmp_path):
    good = tmp_path / "good"
    for t in ("a", "b", "old"):
        result_file(good, t)
    got = results.read_results(spark, str(good), 2, exclude=("old",)).orderBy("task").collect()
    assert [(r.task, r.metric, r.test_mean, r.n_seeds, r.ckpt) for r in got] == [("a", "mae", 1.5, 3, "c1"), ("b", "mae", 1.5, 3, "c1")]
    with pytest.raises(Exception, match="expected 4 tasks, found 3"):
        results.read_results(spark, str(good), 4).collect()
    for name, change, message in (("twice", {"task": "a"}, "task a in .*results_a.json and .*results_twice.json"), ("point", {"ckpt": "c2"}, "two checkpoints, c1 and c2.*results_point.json"), ("none", {"primary_metric": "auroc"}, "no auroc in .*results_none.json"), ("nameless", {"task": None}, "no task or no mae in .*results_nameless.json")):
        folder = tmp_path / name
        result_file(folder, "a")
        result_file(folder, name, **change)
        with pytest.raises(Exception, match=message):
            results.read_results(spark, str(folder), 2).collect()


def test_grouped_csv_contract(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", "ok"), (2, "y", "ok")], "id int, g string, status string")
    sinks.write_csv(df, str(tmp_path / "a"), gzip=True)
    assert results.read_grouped_csv(spark, str(tmp_path / "a"), "id", "g", "status", 2).count() == 2
    with pytest.raises(Exception, match="expected 3 groups, found 2"):
        results.read_grouped_csv(spark, str(tmp_path / "a"), "id", "g", "status", 3).collect()
    sinks.write_csv(df.withColumn("status", F.when(F.col("id") == 2, "failed")), str(tmp_path / "b"), gzip=True)
    with pytest.raises(Exception, match="status of row . in part-.*csv.gz is (none|failed)"):
        results.read_grouped_csv(spark, str(tmp_path / "b"), "id", "g", "status", 2).collect()


def test_split_store(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", "train" if i < 8 else "test") for i in range(10)], "id int, v string, split string")
    where = str(tmp_path / "s")
    assert {r.split: r.n_rows for r in sinks.store_splits(df, where, "id", "split").collect()} == {"train": 8, "test": 2}
    sinks.store_splits(df.repartition(3), where, "id", "split")
    with pytest.raises(RuntimeError, match="not overwritten"):
        sinks.store_splits(df.withColumn("v", F.lit("other")), where, "id", "split")
    with pytest.raises(ValueError, match="more than one split"):
        sinks.store_splits(df.unionAll(df.withColumn("split", F.lit("valid"))), where + "2", "id", "split")


# digests


def test_merkle_digests(spark):
    rows = [("a", f"v{i % 700}") for i in range(1000)] + [("b", f"v{i % 700}") for i in range(999, -1, -1)] + [("c", f"v{i}") for i in range(700)] + [("d", None), (None, "x")]
    df = spark.createDataFrame(rows, "g string, v string")
    got = {r.g: r.digest for r in digests.merkle_digests(df.repartition(5), ["g"], F.col("v")).collect()}
    assert got["a"] == got["b"] != got["c"] and "d" not in got and got[None]
    changed = df.withColumn("v", F.when((F.col("g") == "b") & (F.col("v") == "v5"), "other").otherwise(F.col("v")))
    leaves = digests.merkle_leaves(changed, ["g"], F.col("v"))
    a, b = ({r.leaf: r.digest for r in leaves.where(f"g = '{x}'").collect()} for x in "ab")
    differ = {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    assert differ == {hashlib.sha256(x.encode()).hexdigest()[:4] for x in ("v5", "other")}


def test_ordered_merkle(spark):
    def by_hand(values, leaf=4, fan=2):
        lines = [hashlib.sha256(v.encode()).hexdigest() if v is not None else "" for v in values]
        nodes = [lines[i : i + leaf] for i in range(0, len(lines), leaf)]
        nodes = [hashlib.sha256("\n".join(x).encode()).hexdigest() for x in nodes]
        while len(nodes) > 1:
            nodes = [hashlib.sha256("\n".join(nodes[i : i + fan]).encode()).hexdigest() for i in range(0, len(nodes), fan)]
        return nodes[0]

    groups = {"a": ["x"], "b": [f"v{i}" for i in range(37)], "c": ["v1", None, "v2", "v1", "v0"]}
    df = spark.createDataFrame([(g, i, v) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, i int, v string").repartition(4)
    assert {r.g: r.digest for r in digests.ordered_merkle(df, ["g"], "i", F.col("v"), 4, 2).collect()} == {g: by_hand(v) for g, v in groups.items()}


# generators, states, streams


def test_generators(spark):
    generators.register(spark)
    df = spark.createDataFrame([(1, "One. Two!  Three"), (2, None), (3, ""), (4, "a b c")], "k int, t string")
    rows = df.lateralJoin(generators.sentences(F.col("t").outer())).collect()
    assert [(r.k, r.place, r.start, r.sentence) for r in rows] == [(1, 0, 0, "One."), (1, 1, 4, " Two!"), (1, 2, 9, "  Three"), (4, 0, 0, "a b c")]
    df.createOrReplaceTempView("generated_from")
    got = spark.sql("SELECT k, left, right, distance FROM generated_from, LATERAL word_pairs(t, 2) WHERE k = 4").collect()
    assert sorted((r.left, r.right, r.distance) for r in got) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_metric_states(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(1))
    y, p = rng.normal(size=300), rng.normal(size=300)
    df = spark.createDataFrame([("g", float(a), float(b), i) for i, (a, b) in enumerate(zip(y, p))] + [("g", None, 1.0, 0), ("h", 1.0, 1.0, 0)], "g string, y double, p double, i int")
    store = states.StateStore(str(tmp_path / "s"), ["g"], states.regression_metric("y", "p"))
    store.put(df.where("i < 100"), 0)
    store.put(df.where("i >= 100"), 1)
    store.put(df.where("i >= 100"), 1)  # a repeated batch
    got = {r.g: r for r in store.computed(spark).collect()}
    assert got["g"].n == 300 and np.isclose(got["g"].mae, np.abs(y - p).mean()) and np.isclose(got["g"].rmse, np.sqrt(((y - p) ** 2).mean()))
    assert np.isclose(got["g"].r2, 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()) and np.isclose(got["g"].pearson, np.corrcoef(y, p)[0, 1])
    assert got["h"].r2 is None and got["h"].mae == 0
    store.reset(spark)
    assert not (tmp_path / "s").exists()
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (None, 1)], "y int, p int")
    m = states.binary_metric("y", "p")
    r = states.compute(states.merge(states.update(rows.where("p = 1"), [], m).unionAll(states.update(rows.where("p = 0"), [], m)), [], m), [], m).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 2, 1) and np.isclose(r.balanced_accuracy, (1 / 2 + 2 / 3) / 2) and np.isclose(r.accuracy, 3 / 5)


def test_stream_state_on_disk(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: streams.drain(streams.first_seen(streams.file_stream(spark, src, 2), ["id"]), out, state)
    with streams.disk_state(spark):
        assert "RocksDB" in spark.conf.get(key)
        spark.range(50).repartition(5).write.parquet(src)
        run()
        spark.range(30, 80).repartition(3).write.mode("append").parquet(src)
        run()
    assert spark.conf.get(key, None) == before
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(80))
