"""Operators 11 to 13 against brute force and SQL, and on odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestrata.llm import collocations, embedding_dedup, hard_negatives, html_text, license_scan, quality_rules, token_store, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "  \n\n", "a", "A a A a A a", "x  y\n\n z", "é ü 字 😀", "word " * 5000, "z" * 30000, "a b c a b c a b", "| | |", "#*$%&|<>", "\n".join(["one line here."] * 9), "!!! ???", "ab ab ab ab"]
PROSE = "The river ran past the old mill and nobody saw the heron rise from the reeds before the rain came down. "


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs_frame(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], "clash", True) for i, t in enumerate(texts)]
    return frame(spark, rows, "doc_id long, text string, lang string, n_words string, kept boolean")


def sql_rows(path, name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return columns, sorted(got.fetchall(), key=repr)


# 11: quality rules


def base_by_hand(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeat)


def test_quality_base_counts(spark):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "é ", "A ", "\n", "#", "\t", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = {r.doc_id: r for r in quality_rules.judged(docs_frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], base_by_hand(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_quality_sql_on_odd_texts(spark, tmp_path):
    texts = ODD + [PROSE * 3 + "\n" + x for x in ("Home | About | Contact | Help", "We use cookies.", "Fine words end here.", "no end", "wow!! so!! loud!! indeed")]
    docs = docs_frame(spark, texts + texts)
    docs.write.parquet(str(tmp_path / "d"))
    columns, want = sql_rows(tmp_path / "d", "documents", quality_rules.SQL)
    got = quality_rules.judged(docs).select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        (PROSE, ""), ("Chapter one.", ""), ("Is it so?", ""), ("A heading of four words", ""), ("He paid 5 % more for R&D in 2019.", ""),
        ("Home | About | Contact", "navigation"), ("a > b > c > d", "navigation"), ("one*** two%%% three### four", "punctuation"), ("WHAT!! IS!! THIS!!", "punctuation"),
        ("----", "punctuation"), ("Menu", "punctuation"), ("Accept all cookies to go on.", "boilerplate"), ("x x x x x x x x y z.", "boilerplate"),
    ],
)
def test_quality_line_rules(line, rule):
    assert quality_rules.RULES[quality_rules.line_rule(line)[0]] == rule


def test_quality_verdict_and_text(spark):
    prose = "\n".join(" ".join(f"{w}{i}" for w in "line tells something no other of this text".split()) + " ends." for i in range(12))
    junk = "\n".join(f"Home{i} | About{i} | Contact{i} | Help{i} | Sitemap{i} | Terms{i}" for i in range(12))
    texts = [prose, prose + "\nHome | About | Contact\n" + prose.split("\n")[3], prose + "\n" + junk, junk]
    got = {r.doc_id: r for r in quality_rules.judged(docs_frame(spark, texts)).collect()}
    assert [got[i].kept for i in range(4)] == [True, True, False, False]
    assert got[1].cleaned == prose and got[1].n_navigation == 1 and got[1].n_dup_lines == 1
    assert {r.doc_id: r.text for r in quality_rules.clean(docs_frame(spark, texts)).collect()} == {0: prose, 1: prose}


def test_quality_keeps_good_and_drops_bad(spark, small):
    """Of the labelled rows that pass the base rules."""
    d = small.replace("sf0.001", "sf0.01")
    got = quality_rules.op11_quality_rules(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]


# 12: hard negatives


VECTORS = "vec_id long, embedding array<float>, label int, score string, q int"


def test_hard_negatives_sql_on_odd_rows(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(8))
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4], int(rng.integers(0, 3)), "x", 1) for i in range(900)]
    rows += [(i, [0.5, 0.25, -0.5, 0.0], i % 3, "x", 1) for i in range(900, 1400)]  # many equal vectors: ties by id
    rows += rows[100:200]  # repeated rows
    rows += [(200, [0.5, 0.5, 0.5, 0.5], 1, "x", 1), (200, [0.5, 0.5, 0.5, 0.5], 2, "x", 1)]  # one id, other rows
    rows += [(None, [1.0] * 4, 1, "x", 1), (1500, None, 1, "x", 1), (1600, [1.0] * 4, None, "x", 1), (1700, [1.0, None, 0.0, 0.0], 1, "x", 1), (1800, [math.nan, 0.0, 0.0, 0.0], 1, "x", 1)]
    rows += [(1900, [math.inf, 0.0, 0.0, 0.0], 1, "x", 1), (2000, [0.0] * 4, 1, "x", 1), (2100, [], 1, "x", 1), (2101, [], 2, "x", 1), (2102, [], 1, "x", 1)]
    rows += [(2200 + i, [0.5, float(i) / 8], i % 2, "x", 1) for i in range(12)]  # another length
    rows += [(2300, [3e38] * 4, 1, "x", 1), (2400, [2.0**20] * 4, 1, "x", 1), (2401, [2.0**20] * 4, 1, "x", 1), (2402, [2.0**20 * 0.9375] * 4, 2, "x", 1), (-100, [0.5] * 4, -4, "x", 1), (-7, [0.25] * 4, -1, "x", 1)]
    random.Random(1).shuffle(rows)
    vectors = frame(spark, rows, VECTORS).repartition(7)
    vectors.write.parquet(str(tmp_path / "e"))
    columns, want = sql_rows(tmp_path / "e", "embeddings", hard_negatives.SQL)
    got = hard_negatives.mine(vectors).select(*columns).collect()
    assert len(want) > 100
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_hard_negatives_many_cells(spark, tmp_path, monkeypatch):
    """Clusters, where radii exclude cells: the answer stays that of all pairs, and fewer copies travel."""
    rng = np.random.Generator(np.random.PCG64(9))
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(3000):
        v = centres[i % 12] + 0.05 * rng.normal(size=16)
        rows.append((i * 5, [float(np.float32(x)) for x in v / np.linalg.norm(v)], i % 3, "x", 1))
    vectors = frame(spark, rows, VECTORS)
    vectors.write.parquet(str(tmp_path / "e"))
    columns, want = sql_rows(tmp_path / "e", "embeddings", hard_negatives.SQL)
    monkeypatch.setattr(hard_negatives, "PIVOT_STEP", 1.0)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 64)
    got = hard_negatives.mine(vectors).select(*columns).collect()
    assert len(want) > 1000 and sorted((tuple(r) for r in got), key=repr) == want


def test_cells_hold_what_scores_say():
    rng = np.random.Generator(np.random.PCG64(10))
    q = rng.integers(-300, 300, (200, 8))
    cells = hard_negatives.Cells(q[:5], int((q * q).sum(1).max()))
    rows, anchors = cells.distances(q, True), cells.distances(q, False)
    away = cells.radius((q * q).sum(1)[:, None], q @ q.T)
    for p in range(5):
        assert (np.abs(anchors[:, p][:, None] - rows[:, p]) <= away + cells.slack).all() and (anchors[:, p][:, None] + rows[:, p] >= away - cells.slack).all()


def test_products_are_exact():
    a = np.array([[2**30 + 1, 3]])
    assert hard_negatives.products(a, a).tolist() == [[(2**30 + 1) ** 2 + 9]]


# 13: collocations


def phrases_by_hand(rows, least, depth, top):
    words = [(lang or "und", WORD_13.findall(p)) for text, lang in rows for p in re.split("[.,;:!?\n-\r]", low(text or ""))]
    out = []
    for lang in {x for x, _ in words}:
        own = [w for x, w in words if x == lang]
        n = sum(map(len, own))
        f = Counter(tuple(w[i : i + k]) for w in own for k in range(1, depth + 1) for i in range(len(w) - k + 1))
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        got = []
        for p, a in cand.items():
            if any(len(x) > len(p) and b >= a and any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1)) for x, b in cand.items()):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            got.append((-score, -a, " ".join(p).encode(), lang, a, f[p[:k]], f[p[k:]], n))
        out += [(x[3], i + 1, x[2].decode(), *x[4:], -x[0]) for i, x in enumerate(sorted(got)[:top])]
    return sorted(out)


WORD_13 = re.compile(r"[^\x20\x09]+")


def low(text):
    return text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


@pytest.mark.parametrize(("least", "top", "held"), [(2, 2000, 1 << 18), (5, 30, 64), (300, 2000, 64)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, top, held):
    rng = random.Random(least)
    vocabulary = ["the", "The", "of", "rare", "é", "字", "İx", "x-y", "a"] + [f"w{i}" for i in range(30)]
    texts, langs = list(ODD), ["en", None, "und", "de"] * 4
    for i in range(400):
        texts.append("".join(rng.choice(vocabulary[: rng.choice([4, 39])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\xa0"]) for _ in range(rng.randrange(40))))
        langs.append(rng.choice(["en", "en", "fr", None]))
    monkeypatch.setattr(collocations, "HELD_PATHS", held)
    monkeypatch.setattr(collocations, "HELD_WORDS", 100)
    monkeypatch.setattr(collocations, "RANGE_WORDS", 1000)
    docs = docs_frame(spark, texts, langs).repartition(5)
    got = sorted(tuple(r) for r in collocations.phrases(docs, least, top=top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == phrases_by_hand(list(zip(texts, langs)), least, 5, top) and got


def test_tries_round_trip():
    rng = np.random.Generator(np.random.PCG64(3))
    paths = rng.integers(1, 6, (500, 5)).astype(np.uint64)
    for i, n in enumerate(rng.integers(2, 6, 500)):
        paths[i, n:] = 0
    t = collocations.Trie(paths, np.ones(500, np.int64))
    assert t.n.sum() == 500
    seen = 0
    for _, p, n in t.ranges(7):
        q, m = collocations.unpack_trie(collocations.pack_trie(p, n))
        assert (q == p).all() and (m == n).all()
        seen += m.sum()
    assert seen == 500
    words, n = t.nodes(3)
    want = Counter(tuple(r[:3]) for r in paths.tolist() if r[2])
    assert dict(zip(map(tuple, words.tolist()), n.tolist())) == want


def test_pair_counters_lose_nothing(spark, small):
    """Every pair that reaches the bar has its bit, with saturating and with wide counters."""
    for least in (100, 300):
        texts = docs_frame(spark, ["the cat " * 40, "The cat sat"] * 10).select("lang", "text")
        bits = collocations.frequent_buckets(collocations.counted(texts, least), least)
        h = collocations.words_of(__import__("pyarrow").array(["the cat the"]))[3]
        for a, b in ((0, 1), (1, 2)):
            at = int(collocations.buckets("en", h[a : a + 1], h[b : b + 1])[0])
            assert bits[at >> 3] >> (7 - (at & 7)) & 1


def test_new_operators_take_empty_tables(spark):
    docs = docs_frame(spark, [])
    assert quality_rules.judged(docs).count() == quality_rules.clean(docs).count() == collocations.phrases(docs).count() == 0
    assert hard_negatives.mine(frame(spark, [], VECTORS)).count() == 0
    assert hard_negatives.mine(frame(spark, [(7, [1.0], 1, "x", 1), (101, [1.0], 1, "x", 1)], VECTORS)).count() == 0  # no anchor


# 5: doubles in disguise


def test_decoder_keeps_real_doubles(spark, small):
    """With the letter counts of the documents, in which doubles are rare."""
    d = toxicity.Decoder(toxicity.letter_counts(spark.read.parquet(f"{small}/documents.parquet")))
    cases = {
        "w0rthless": "worthless", "w0rthl3ss": "worthless", "worthle$$": "worthless", "w.o.r.t.h.l.e.s.s": "worthless", "w0rthle$s": "worthless", "worthlesssss": "worthless", "a55hole": "asshole",
        "killl": "kill", "loo0oser": "loser", "st00pid": "stoopid", "b00000k": "book", "l1ke": "like", "s-t-u-p-i-d": "stupid",
    }
    for x, word in cases.items():
        line = d.restored_many(__import__("pyarrow").array([x]))[0].split("\n")[1:]
        assert word in line, (x, line)
    assert len(d.decode("a00b11c33d44e55f77")) <= 15


# 10: statements by their form


STATEMENTS = [
    "Copyright (c) 2024 Brian May", "Copyright (c) 2019-2024 Will Must and contributors", "Copyright (c) 2020 Use Design Ltd", "Copyright (c) 2024 Jane Use <jane@use.org>", "(c) 2024, John R. Smith, Inc. All rights reserved.",
    "Copyright 2024 Acme Inc.", "Copyright © 2010–present St. Louis Group GmbH & Co. KG", " * Copyright (C) 2001, 2002, 2005 The Example Project Authors (https://example.org)", "Copyright (c) 2024\n  Jane Doe", "Copyright (c) 2024,\n *  Jane Doe",
    "copyright (c) 2015 john smith", "COPYRIGHT (C) 2015 JOHN SMITH", "Copyright Jane Doe", "© Jane Doe 2021", "Copyright (c) 2024 O'Neil van der Berg", "Copyright (c) 2024 字节",
]
CLAUSES = [
    "Copyright 2024 Acme. Redistribution costs five dollars.", "(c) 2024 Acme, commercial redistribution forbids resale", "Copyright 2024 Acme: only noncommercial redistribution is licensed; pay us first",
    "Copyright 2024 Acme. Pay us.", "Copyright (c) 2024 Acme (you may not sell this)", "COPYRIGHT 2024 ACME. YOU MAY NOT SELL IT", "copyright 2024 acme, you must not sell it", "Copyright (c) 2024 Acme\nYou owe us money.", "(c) The licensee pays a fee.",
]


def test_statements_by_their_form(spark, tmp_path):
    """Statements are no part of a licence, whatever the holder's name; what says more is. Both engines agree."""
    mit = dict(license_scan.KNOWN)["MIT"]
    bare = mit.split("\n\n", 1)[1] if mit.startswith("MIT") or mit.startswith("The MIT") or "License" in mit.split("\n")[0] else mit
    heads = ["The MIT License\n\n", "The MIT License (MIT)\n\n", "MIT License\n\n", ""]
    texts = [heads[k % 4] + x + "\n\n" + bare for k, x in enumerate(STATEMENTS)] + ["MIT License\n\n" + x + "\n\n" + bare for x in CLAUSES] + [bare + "\n" + x for x in STATEMENTS + CLAUSES]
    docs = docs_frame(spark, texts)
    got = {r.doc_id: (r.canonical_sha256, r.license) for r in license_scan.scan(docs, license_scan.known_digests(spark)).collect()}
    a, b = len(STATEMENTS), len(CLAUSES)
    want = ["MIT"] * a + [None] * b + ["MIT"] * a + [None] * b
    assert [(texts[i][:90], texts[i][-60:]) for i in range(len(texts)) if got[i][1] != want[i]] == []
    docs.write.parquet(str(tmp_path / "d"))
    columns, rows = sql_rows(tmp_path / "d", "documents", license_scan.SQL)
    assert rows == sorted(((i, *got[i]) for i in got), key=repr) and columns == ["doc_id", "canonical_sha256", "license"]


def test_known_headings_are_distinct():
    assert len({(n, t) for n, t in license_scan.KNOWN}) == len(license_scan.KNOWN) > 30


# 7: compressed shards


def test_code_lengths_are_huffman():
    import heapq

    rng = np.random.Generator(np.random.PCG64(2))
    for counts in ([5], [1, 1], [1] * 7, [100, 1, 1, 1], rng.integers(1, 1000, 300).tolist(), [2**k for k in range(30)]):
        lengths = token_store.code_lengths(np.array(counts))
        heap, cost = list(counts), 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert int((lengths * counts).sum()) == (cost or counts[0]) and (len(counts) == 1 or sum(2.0**-x for x in lengths.tolist()) == 1)


def test_shaped_matrix_on_skewed_ids():
    rng = np.random.Generator(np.random.PCG64(3))
    for a in (rng.zipf(1.3, 20000) % 50257, np.full(700, 9), np.array([4]), np.repeat(np.arange(24), 2 ** np.minimum(np.arange(24), 11)), rng.integers(0, 2, 3000) * 70000):
        a = rng.permutation(a).astype(np.uint32)
        raw = token_store.Shard([1], np.array([len(a)]), token_store.WaveletMatrix.build(a)).to_bytes()
        m = token_store.Shard.from_bytes(raw).matrix
        assert (m.values() == a).all() and (m.access(np.arange(len(a))) == a).all()
        for t in np.unique(a)[[0, -1, len(np.unique(a)) // 2]].tolist():
            places = np.flatnonzero(a == t)
            assert m.count(t) == len(places) and m.rank(t, len(a) // 3) == (places < len(a) // 3).sum()
            assert [m.select(t, k) for k in (0, len(places) // 2, len(places) - 1)] == places[[0, len(places) // 2, -1]].tolist()
        assert m.count(123456) == 0
        with pytest.raises(IndexError):
            m.select(123456, 0)
    with pytest.raises(ValueError, match="16 bits"):
        token_store.WaveletMatrix.build(np.array([70000], np.uint32), 16)


def test_shards_are_compressed(spark, small, tmp_path):
    """Fewer bytes than a token's ids need in 16 bits each, by far, on whole documents."""
    import glob

    docs = spark.read.parquet(small.replace("sf0.001", "sf0.1") + "/documents.parquet").where("doc_id < 2000")
    manifest = token_store.write_shards(docs, f"file://{tmp_path}/t").collect()
    size = sum(len(open(f, "rb").read()) for f in glob.glob(f"{tmp_path}/t/*.lwm"))
    assert size / sum(r.n_tokens for r in manifest) < 1.4


# 1: parts by other names, very long pages


@pytest.mark.parametrize("mark", ["reader-comments", "discussion", "user-discussions", "comment-respond", "readers", "discussion-paper"])
def test_comments_by_their_names(mark):
    story = "<p>" + "The council voted on Tuesday to keep the old bridge open for another year. " * 4 + "</p>"
    page = f"<html><body><div class='story'>{story * 3}<div class='{mark}'><p>{'I was there and saw it all happen, believe me, it was a shame. ' * 3}</p></div></div></body></html>"
    assert ("I was there" in html_text.main_text(page)) == (mark in ("readers", "discussion-paper"))


def test_very_long_page(spark):
    story = "".join(f"<p>Paragraph {i} of a very long report, with enough words to count as text of its own.</p>" for i in range(20_000))
    page = f"<html><body><nav><a href='/'>Home</a></nav>{story}<footer>Imprint</footer></body></html>"
    rows = html_text.extract(spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None)], "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in rows) == [0, *[len(html_text.main_text(page))] * 2]
    got = rows[0].text if rows[0].text else rows[1].text
    assert got.count("\n\n") == 19_999 and "Imprint" not in got and "Home" not in got


# 4, 5, 9: very long values and repeated rows


def test_very_long_urls_and_repeated_rows(spark):
    deep = "http://" + ".".join(["a"] * 60) + ".example.net/en/" + "x/" * 3000 + "?q=" + "y" * 5000
    rows = [(1, deep), (1, deep), (2, "http://example.net/de/"), (2, "http://example.net/de/"), (None, deep), (3, "http://" + "z" * 20_000 + ".com/de/")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), url_filter.rule_frame(spark)).collect()
    assert len(got) == 6 and [r.verdict for r in got if r.url_rule == "example.net/en/"] == ["allow"] * 3 if "url_rule" in got[0] else sorted(r.rule or "" for r in got) == ["", "example.net/en/", "example.net/en/", "example.net/en/", "net/", "net/"]


def test_very_long_text_is_judged_whole(spark):
    rng = random.Random(17)
    words = [f"w{chr(97 + i)}{chr(97 + j)}o" for i in range(20) for j in range(20)]
    text = lambda n, bad: " ".join(rng.choices(words, k=n) + (["scumbag"] if bad else []))
    texts = [text(20, i % 4 == 0) for i in range(300)] + [text(60_000, True), text(60_000, False)]
    docs = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.judge(docs, labels).collect()}
    assert (got[300], got[301]) == (1, 0)


def test_rows_of_one_id_under_other_labels(spark):
    v, w = [1.0, 0.0], [0.99, 0.05]
    rows = [(1, v, 0), (1, v, 1), (2, w, 0), (3, w, 1), (4, v, 2), (1, v, 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
