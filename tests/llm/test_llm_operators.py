"""The ten operators against brute force, libraries and SQL, and on odd inputs."""

import base64
import glob
import hashlib
import os
import random
import re
import textwrap
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import bpe_codec, decontaminate, embedding_dedup, html_text, license_scan, ngram_join, queries, token_counts, token_store, toxicity, url_filter
from lodestrata.llm import _components
from lodestrata.llm._common import SHUFFLES_GO, drop, shared_dir, written
from lodestrata.llm._components import components
from lodestrata.llm._shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " ", "  \n", "a", "don't they're", "x  y\n\n z", "They'r", "é ü 字 😀", "1234 5678", "<|endoftext|>", "a<|endoftext|>b!<|endo", "word " * 3000, "z" * 3000, "'s's", " ' 've"]


def docs_frame(spark, texts, **more):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_tokens int")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, small, con, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    plain = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert plain(got) == plain(want)


def test_every_operator_takes_an_empty_table(spark, tmp_path):
    docs, labels = docs_frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert token_counts.totals(docs).count() == token_counts.prefix_counts(docs).count() == 0
    assert ngram_join.link(docs).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rule_frame(spark)).count() == 0
    assert toxicity.judge(docs, labels).count() == 0
    assert decontaminate.find(docs, items).count() == 0
    assert token_store.read_shards(spark, str(tmp_path), token_store.write_shards(docs, str(tmp_path))).count() == 0
    assert bpe_codec.digests(docs).count() == 0
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert license_scan.scan(docs, license_scan.known_digests(spark)).count() == 0


# 1


def test_html_articles_and_the_rest():
    page = (
        "<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=/>no</a></ul></nav><header>no</header><!-- no -->"
        "<div class='cookie-notice'>no</div><article><h1>Head &amp; more</h1><p>One  two<br>three<p>Four &#x41;&nbsp;&am <b>five</b></p>"
        "<div class=ad>no</div><form><p>no</p></form><aside>no</aside><section id=comments><p>no</p></section><script>'<p>no</p>'</script>end</article><footer>no</footer>"
    )
    assert html_text.main_text(page) == "Head & more\n\nOne two three\n\nFour A &am five\n\nend"


def test_html_without_article_uses_density():
    menu = "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(9))
    page = f"<body><ul>{menu}</ul><div>{'Some words of the text. ' * 10}</div><p>{'And more of the text here. ' * 8}</p><ul>{menu}</ul></body>"
    text = html_text.main_text(page)
    assert text.startswith("Some words") and text.count("\n\n") == 1 and "item" not in text


def test_html_marks_and_teasers():
    text = html_text.main_text
    long = "This sentence is long enough to count as running text of the page itself, and more follows in it."
    assert text("<article><p>Body.</p><article class='comment'><p>Reader says.</p></article></article>") == "Body."
    kept = "<section id='related-work'><h2 id='search'>Search</h2><h2 id='menu'>Menu</h2><p class='notice-period'>One month.</p><p class='lead search-engine'>Lead.</p></section>"
    assert text(f"<main><h1>T</h1>{kept}</main>") == "T\n\nSearch\n\nMenu\n\nOne month.\n\nLead."
    assert text("<main><p>a</p><div class='ad-slot'>Buy</div><div class='comments-area'>x</div><p>b</p></main>") == "a\n\nb"
    assert text("<p>" + long + "</p><![x y]><p>" + long + "</p>") == long + "\n\n" + long
    # a short teaser marked as an article: the windows over the whole page decide
    assert text(f"<article><p>Teaser.</p></article><div><a href='/'>one two three four five six seven</a></div><div><a href='/'>eight</a></div><div><a>nine</a></div><div>{long}</div><div>{long}</div>").endswith(long + "\n\n" + long)


def test_html_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>a"), (4, "u", "<article>x"), (4, "u", "<article>x"), (5, "u", "<"), (6, "u", "<!DOCTYPE <![ <p>b")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(9))).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got[:5]] == ["", "", "a", "x", "x"]


# 2


def test_prefix_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.prefix_counts(docs_frame(spark, ODD_TEXTS)).collect()
    for r in got:
        text = ODD_TEXTS[r.doc_id] or ""
        assert len(r.prefix_tokens) == len(text)
        for i in {*range(1, min(len(text), 40) + 1), len(text)} - {0}:
            assert r.prefix_tokens[i - 1] == count(text[:i]), text[:i]


def test_random_prefixes():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    rng = random.Random(3)
    parts = ["'", "'re", "'ll", " ", "  ", "\n", "a", "the", "é", "1", "!?", "字", "\u3000", "don't", "<|endoftext|>", "<|endo", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(150)]
    c = token_counts.counter(public_tokenizers.path(token_counts.TOKENIZER))
    for t, counts in zip(texts, c.many(pa.array(texts))):
        assert counts.tolist() == [len(library.encode(t[:i], add_special_tokens=False).ids) for i in range(1, len(t) + 1)], t


def test_budget_questions(spark):
    df = token_counts.prefix_counts(docs_frame(spark, ["one two three four five", "", None]))
    r = df.select("doc_id", token_counts.longest_prefix(F.col("prefix_tokens"), 2).alias("fit"), token_counts.tokens_of_prefix(F.col("prefix_tokens"), 7).alias("n")).orderBy("doc_id").collect()
    assert [(x.fit, x.n) for x in r] == [(7, 2), (0, 0), (0, 0)]
    t = {x.doc_id: x for x in token_counts.totals(docs_frame(spark, ["one two three", None]), limit=2).collect()}
    assert (t[0].n_bytes, t[0].n_tokens, t[0].over_limit, t[0].chars_in_limit) == (13, 3, True, 7)
    assert (t[1].n_bytes, t[1].n_tokens, t[1].over_limit) == (0, 0, False)


# 3


def variants(rng, n_words, n):
    base = [f"w{rng.randint(0, 999)}" for _ in range(n_words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(n_words)] = f"v{rng.randint(0, 9)}"
        out.append(" ".join(w))
    return out


def jaccard_case(seed):
    rng = random.Random(seed)
    texts = [t for k in (30, 60, 90, 200) for t in variants(rng, k, 25)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += ["a b c", "A  b\tc", "a b c d", None, "", "  ", texts[0], texts[0].upper()]
    return texts


@pytest.mark.parametrize("frequent,chunk", [(24, 2048), (3, 8)])
def test_ngram_join_against_all_pairs(spark, monkeypatch, frequent, chunk):
    monkeypatch.setattr(ngram_join, "FREQUENT_MIN", frequent)
    monkeypatch.setattr(ngram_join, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 2 * chunk)
    texts = jaccard_case(frequent)
    sets = [shingles(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = brute_components(range(len(texts)), links)
    got = {r.doc_id: r for r in ngram_join.link(docs_frame(spark, texts).repartition(5)).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_shingles for k, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_ngram_join_pairs_grow_with_the_group_and_not_its_square(spark, monkeypatch):
    """Near copies that all meet texts they do not link with: what is tried is a few pairs for each text."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    base = [word() for _ in range(200)]
    near = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in (rng.randrange(5, 195) for _ in range(200))]
    far = [" ".join(base[k : k + 120] + [word() for _ in range(80)]) for k in (rng.randrange(80) for _ in range(600))]
    seen, own = [], ngram_join.bounded
    monkeypatch.setattr(ngram_join, "FREQUENT_MIN", 1 << 40)  # no rare shingles first, so that all meet
    monkeypatch.setattr(ngram_join, "bounded", lambda pairs, *rest: seen.append(pairs.count()) or own(pairs, *rest))
    got = {r.doc_id: r.component_id for r in ngram_join.link(docs_frame(spark, near + far)).collect()}
    assert got == {i: 0 if i < len(near) else i for i in range(len(near) + len(far))}
    assert sum(seen) <= 4 * len(got), seen  # 19,900 in one round when each two components tried a pair


def test_ngram_join_sharp_points_and_first_tries():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 7, 300, 900, ngram_join.PRINTS, 4 * ngram_join.PRINTS)]
    sets += [np.unique(np.concatenate([s[: len(s) // 2], rng.integers(0, 1 << 63, len(s) // 3 + 1, dtype=np.uint64)])) for s in sets]
    sets.append(np.unique(np.arange(40, dtype=np.uint64) << np.uint64(16)))  # one print, many times
    sharp = [ngram_join.sharp_point(s) for s in sets]
    small = [k for k, s in enumerate(sets) if len(s) <= ngram_join.PRINTS]
    bound = {(a, b): ngram_join.sharp_bound(len(sets[a]), sharp[a], len(sets[b]), sharp[b]) for a in range(len(sets)) for b in range(len(sets))}
    for (a, b), most in bound.items():
        assert len(np.intersect1d(sets[a], sets[b])) <= most <= min(len(sets[a]), len(sets[b])), (a, b)
    counts = [ngram_join.fine_counts(len(x), ngram_join.fine_point(len(x), y)) for x, y in zip(sets, sharp)]
    a, b = (np.array(x) for x in zip(*bound))
    for (i, j), most in zip(bound, ngram_join.shared_counts(counts, a, b).tolist()):
        assert len(np.intersect1d(sets[i], sets[j])) <= most <= min(len(sets[i]), len(sets[j])), (i, j)
    twins = [np.unique(rng.integers(0, 1 << 63, 12000, dtype=np.uint64)) for _ in range(2)]
    loose = ngram_join.overlap_bound(*[ngram_join.counts_of(ngram_join.point(x, ngram_join.GROUPS), ngram_join.GROUPS) for x in twins])
    tight = ngram_join.shared_counts([ngram_join.fine_counts(len(x), ngram_join.fine_point(len(x), ngram_join.sharp_point(x))) for x in twins], np.array([0]), np.array([1]))[0]
    assert tight < ngram_join.least_overlap(np.int64(24000), 75) <= loose  # long texts that have nothing in common
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(small)) for j in range(len(small)) if i != j]))
    assert ngram_join.shared_prints([sharp[k] for k in small], a, b).tolist() == [bound[small[i], small[j]] for i, j in zip(a, b)]
    x, y = (v.astype(np.int64) for v in np.triu_indices(50, 1))
    score = rng.integers(0, 9, len(x)) / 9
    for most in (1, 3, 60):
        at = ngram_join.tried_first(score, x, y, most)
        assert len(at) == len(set(at.tolist())) <= (49 if most == 1 else min(len(x), 49 + 50 * most))
        assert len(set(brute_components(range(50), [(int(x[k]), int(y[k])) for k in at]).values())) == 1
        for g in range(50) if most > 1 else []:
            mine = np.flatnonzero((x == g) | (y == g))
            assert sorted(score[np.intersect1d(mine, at)])[-min(most, 49) :] == sorted(score[mine])[-min(most, 49) :]


def test_shuffles_go_with_their_write_and_tables_with_their_last_reader(spark):
    def shuffled():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f for d in dirs for f in glob.glob(f"{d.getPath()}/*/shuffle_*")}

    def tables():
        return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/lodestrata/*"))

    before, setting = shuffled(), spark.conf.get(SHUFFLES_GO, None)
    t = written(spark.range(5000).repartition(3, "id"), "freed")
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(SHUFFLES_GO, None) == setting
    assert t.count() == 5000
    drop(t)
    for run in (ngram_join.link, ngram_join.keep_one):
        own = tables()
        got = run(docs_frame(spark, jaccard_case(7)))
        left = {os.path.basename(x).split("-")[0] for x in tables() - own}
        assert left <= {"rows", "named", "judged", "links", "tried", "pairs"}, left  # none with points, sets or texts
        assert got.count() > 0


def test_ngram_join_ids_and_rows_twice(spark):
    t = "a b c d e f g h"
    rows = [(None, t), (5, t), (5, t), (3, t + " i"), (9, "other words are in this text"), (None, None), (9, "other words are in this text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.link(df).collect()), key=repr)
    assert got == sorted([(None, 3), (5, 3), (5, 3), (3, 3), (9, 9), (None, None), (9, 9)], key=repr)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == sorted([3, 9, None], key=repr)


def test_keep_one_decides_by_text_and_not_by_id(spark, monkeypatch):
    a, b = "a b c d e f g h", "other words are in this text"
    cases = [
        ([(1, a), (5, a), (5, b)], [(1, a), (5, b)]),
        ([(7, a), (7, b)], [(7, a), (7, b)]),
        ([(7, a), (None, a), (None, b), (None, b), (7, None), (7, " ")], [(7, a), (None, b), (7, None), (7, " ")]),
        ([(2, a), (2, a + " i"), (2, a.upper())], None),
    ]
    for most in (1 << 18, -1):
        monkeypatch.setattr(ngram_join, "BROADCAST_NODES", most)
        for rows, want in cases:
            df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, k1 string, stays int, component int")
            got = ngram_join.keep_one(df)
            assert got.columns == df.columns
            got = [(r.doc_id, r.text) for r in got.collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr) if want else len(got) == 1 and got[0] in rows
    empty = spark.createDataFrame([], "doc_id long, text string, k1 string")
    assert ngram_join.keep_one(empty).collect() == []


def test_tree_finds_all_pairs_the_bound_allows():
    rng = np.random.default_rng(1)
    base = rng.poisson(2, (6, ngram_join.GROUPS))
    points = np.concatenate([np.maximum(0, b + rng.integers(-1, 2, (30, ngram_join.GROUPS)) * (rng.random((30, ngram_join.GROUPS)) < 0.1)) for b in base]).astype("u1")
    sizes, groups = points.sum(1).astype(np.int64), rng.integers(0, 9, len(points))
    x, y, score = ngram_join.RTree(points, sizes, groups).pairs(75)
    assert np.allclose(score, np.minimum(points[x], points[y]).sum(1) / (sizes[x] + sizes[y]))
    got = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
    want = {(a, b) for b in range(len(points)) for a in range(b) if groups[a] != groups[b] and 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b]) and np.minimum(points[a], points[b]).sum() >= -(-75 * (sizes[a] + sizes[b]) // 175)}
    assert got == want


@pytest.mark.parametrize("local", [1 << 20, 9])
def test_components_of_chains_and_stars(spark, monkeypatch, local):
    monkeypatch.setattr(_components, "LOCAL_EDGES", local)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    rng.shuffle(edges)
    want = brute_components({x for e in edges for x in e}, edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k != 500}


# 4


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://NET/x", "http://a.net/", "http://a.net", "http://example.net/en/1?q", "http://sub.example.net/de/#", "https://example.com/de/x", "x://org/fr/", "http://notnet/x", "a://b://c.net/"]
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1)), url_filter.rule_frame(spark)).orderBy("page_id").collect()]
    none = ("", "", None, "allow")
    assert got == [
        none, none, none, ("net", "/x", "net/", "block"), ("a.net", "/", "net/", "block"), ("a.net", "", None, "allow"), ("example.net", "/en/1", "example.net/en/", "allow"),
        ("sub.example.net", "/de/", "net/", "block"), ("example.com", "/de/x", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"), ("notnet", "/x", None, "allow"), ("b:", "//c.net/", None, "allow"),
    ]
    assert url_filter.judge(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), url_filter.rule_frame(spark, [])).first().verdict == "allow"


# 5


def test_decoder_restores_disguised_words():
    text = ("you idiot and stupid clown are worthless pathetic trash " * 50).encode()
    c = toxicity._CODE[np.frombuffer(text, np.uint8)]
    d = toxicity.Decoder(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3))
    got = d.restored_many(pa.array(["1d10t", "c l o w n", "stuuuupid", "w0rthl3ss p.a.t.h.e.t.i.c", "plain words", None, ""]))
    for word, line in zip(("idiot", "clown", "stupid"), got):
        assert word in line.split("\n")[1:]
    assert "worthless" in got[3] and "pathetic" in got[3]
    assert got[4:] == ["plain words", "", ""]


def test_decoder_restores_mixed_and_bordering_disguises():
    """Spaced look-alikes, look-alikes at word ends, doubled letters, and spaced words beside one-letter words."""
    text = ("you idiot and stupid clown are worthless pathetic moron " * 50).encode()
    c = toxicity._CODE[np.frombuffer(text, np.uint8)]
    d = toxicity.Decoder(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3))
    cases = [
        ("m 0 r 0 n", "moron"), ("i d 1 o t", "idiot"), ("$ t u p 1 d", "stupid"), ("worthle$$", "worthless"), ("idio7", "idiot"), ('"idio7!"', "idiot"),
        ("stuupid", "stupid"), ("you are a s t u p i d man", "stupid"), ("c l o w n i say", "clown"), ("ä m 0 r 0 n", "moron"),
    ]
    got = d.restored_many(pa.array([None, *(x for x, _ in cases)]))[1:]
    for (x, word), line in zip(cases, got):
        assert re.search(rf"(?<![^\W\d_]){word}(?![^\W\d_])", line.split("\n", 1)[-1]), (x, line)
    alone = [d.restored_many(pa.array([x]))[0] for x, _ in cases]
    assert alone == got


def test_toxicity_reads_only_tokens_that_may_be_disguised():
    d = toxicity.Decoder(np.ones(28**3, np.int64))
    got = d.restored_many(pa.array(["Plain words stand here, thhe rest too (Thhe end).", None, "", "thhe"]))
    assert set(d.seen) == {b"thhe", b"(Thhe", b"too"}  # plain tokens take no time and no memory
    assert got[1:3] == ["", ""] and got[3].startswith("thhe")
    # whatever lower case and Unicode make of a token, none that has a sign beside a letter or a letter twice is left out
    rng = random.Random(5)
    alphabet = "aabbsoteilSTAOKI0013455678@@$$!|+€*.,- \t\n\x1c\x85\xa0\u2009éÉßẞİıK\u212aÅ\u212bΣσςǅ字😀'’µ̇ªſⅷ"
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 8, 60]))) for _ in range(2000)]
    found, at = toxicity.odd_tokens(*toxicity.string_buffer(pa.array(texts)))
    for text, a, b in zip(texts, at, at[1:]):
        kept = {t for raw in found[a:b] for t in raw.decode().lower().split()}
        assert {t for t in text.lower().split() if any(toxicity._ODD.search(m[0]) for m in toxicity._PIECE.finditer(t))} <= kept <= set(text.lower().split())


def test_toxicity_places_of_plain_letters_decode_as_letter_by_letter():
    text = b"the queen of the hill will read a little book about an idiot in the pool and a clown " * 9
    c = toxicity._CODE[np.frombuffer(text, np.uint8)]
    d = toxicity.Decoder(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3))
    rng = random.Random(6)
    for _ in range(500):
        span = "".join(rng.choices("thequenidotclwé01$s*!", k=rng.randrange(1, 14)))
        places = [[x for way in ways for x in way] for ways in d.lattice(span)]
        flat = []
        for p in places:
            flat += [[(c, 0.0, (toxicity.code(c),))] for c in p[0][0]] if len(p) == 1 and len(p[0][0]) > 1 else [p]
        assert d.likeliest(places) == d.likeliest(flat)


def test_toxicity_held_out_and_odd_rows(spark):
    rng = random.Random(2)
    words = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = rng.choices(words, k=30) + ([rng.choice(["scumbag", "sc*mbag" if i % 2 else "scumbag", "dreckskerl"])] if bad else [])
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    docs = docs_frame(spark, [*texts, None, "", texts[0]]).union(spark.createDataFrame([(None, "scumbag", "c", 1)], "doc_id long, text string, component_id string, n_tokens int"))
    frame = spark.createDataFrame([*labels, (1, 1, 1), (None, 1, 1), (403, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, frame).toPandas()
    assert len(got) == 404 and got.score.between(0, 1).all()
    own = got[got.doc_id.notna() & (got.doc_id < 400)]
    assert (own.held_out == own.doc_id.map(lambda i: zlib.crc32(str(int(i)).encode()) % 4 == 2)).all()
    held = own[own.held_out]
    assert ((held.predicted == 1) == (held.doc_id % 5 == 0)).mean() > 0.97
    assert not got[got.doc_id.isna()].held_out.any()
    assert (got.predicted == (got.score >= 0.3)).all()
    kept = toxicity.clean(docs, frame)
    assert kept.columns == docs.columns and kept.count() == int((got.score < 0.3).sum())


# 6


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic in (0, 1)").toPandas()
    rank, toxic = got.score.rank(), got.toxic == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (rank[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.75
    assert got.predicted[~toxic].mean() < 0.02 and ((got.score >= 0) & (got.score <= 1)).all()


def test_decontamination_against_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"t{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=n)) for n in (5, 9, 14, 30, 31, 32, 60, 120)] + ["only three words", None, "", items_twice := "same item text of seven words"] + [items_twice]
    docs = []
    for k in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 300))
        part = (rng.choice(items) or "").split()
        for _ in range(rng.randint(0, 3)):
            if part:
                part[rng.randrange(len(part))] = "changed"
        at = rng.randint(0, len(w))
        docs.append(" ".join(w[:at] + part + w[at:]).upper() if k % 2 else " \n".join(w[:at] + part + w[at:]))
    docs += [None, "", "Only three WORDS", "only three words more"]
    want = set()
    for i, t in enumerate(docs):
        for j, s in enumerate(items):
            a, b = shingles(t), shingles(s)
            if b and 100 * len(a & b) >= 75 * len(b):
                want.add((i, j, len(b), len(a & b)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame = docs_frame(spark, docs)
    for block in (1 << 20, 50):
        monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", block)
        got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in decontaminate.find(frame, bench).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate.clean(frame, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, *_ in want}


# 7


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        a = rng.integers(0, 50257, n).astype(np.uint32)
        a[: n // 3] = 7
        m = token_store.Shard.from_bytes(token_store.Shard([1, None], np.array([n // 2, n]), token_store.WaveletMatrix.build(a, 16)).to_bytes()).matrix
        assert (m.values() == a).all()
        if n:
            i = rng.integers(0, n, 40)
            assert (m.access(i) == a[i]).all()
            for t in (7, int(a[-1]), 99999):
                places = np.flatnonzero(a == t)
                assert (m.count(t), m.rank(t, n // 2)) == (len(places), int((places < n // 2).sum()))
                assert [m.select(t, k) for k in (0, len(places) - 1) if len(places)] == [int(places[k]) for k in (0, len(places) - 1) if len(places)]


def test_token_encoder_asks_for_new_pieces_together(monkeypatch):
    e = token_store.Encoder(public_tokenizers.path(token_store.TOKENIZER))
    rng = random.Random(8)
    texts = [t or "" for t in ODD_TEXTS] + ["\0", "\0\0 a\0", "abcdefg abcdefgh", "ÿþ \xff", ""]
    texts += ["".join(rng.choices("aabehinorst  'sé字😀\0\n19.", k=rng.randrange(80))) for _ in range(300)]
    want = [np.array([*x.ids, 2], e.kind).tobytes() for x in e.library.encode_batch(texts, add_special_tokens=False)]
    alone, one_by_one = e.piece_ids, []
    monkeypatch.setattr(e, "piece_ids", lambda piece: one_by_one.append(piece) or alone(piece))
    for part in (texts, texts[::-1]):  # new pieces, then remembered ones
        got = e.many(pa.array(part), 2)
        assert got == want
        want.reverse()
    assert e.parting and len(one_by_one) < len(e.pieces) / 2  # else each is a call of its own
    # without a byte for parting all pieces go alone, and ids are the same
    plain = token_store.Encoder(public_tokenizers.path(token_store.TOKENIZER))
    plain.parting = b""
    assert plain.many(pa.array(texts), 2) == want


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_store.TOKENIZER))
    docs = docs_frame(spark, ODD_TEXTS).repartition(3)
    where = f"file://{tmp_path}/t"
    manifest = token_store.write_shards(docs, where, shard_tokens=100)
    left_over = token_store.Shard([7], np.array([3]), token_store.WaveletMatrix.build(np.array([1, 2, 3], "<u2"), 16), 0, 999)
    token_store.put(f"{tmp_path}/t/part-0000000-000999.lwm", left_over.to_bytes())  # of a failed attempt
    got = token_store.read_shards(spark, where, manifest).orderBy("doc_id").collect()
    assert len(got) == len(ODD_TEXTS)
    at = 0
    for r, t in zip(got, ODD_TEXTS):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(glob.glob(f"{tmp_path}/t/*.lwm")) >= 4
    assert token_store.full_path(spark, f"{tmp_path}/t") == f"file:{tmp_path}/t"


# 8


def test_codec_is_tiktokens(spark):
    import tiktoken

    with open(public_tokenizers.path(bpe_codec.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe_codec.digests(docs_frame(spark, ODD_TEXTS)).collect()
    for r in got:
        ids = library.encode_ordinary(ODD_TEXTS[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((ODD_TEXTS[r.doc_id] or "").encode()).hexdigest()
    rng = random.Random(1)
    c = bpe_codec.Codec(public_tokenizers.path(bpe_codec.RANKS))
    c.transducer.max_states = 50  # forgotten states are made again
    for _ in range(300):
        t = "".join(rng.choices(["'", " ", "\n", "ab", "thing", "é", "字", "😀", "1", "?!"], k=rng.randint(1, 20)))
        ids = c.encode(t)
        assert ids == library.encode_ordinary(t)
        assert "".join(c.decode_stream(ids, chunk=1)) == t


def test_utf8_stream_in_any_cut():
    import codecs

    rng = random.Random(6)
    for _ in range(300):
        data = b"".join(rng.choice(["a", "é", "字", "😀"]).encode() if rng.random() < 0.9 else bytes([rng.randrange(256)]) for _ in range(rng.randint(0, 12)))
        s, out, at = bpe_codec.Utf8Stream(), [], 0
        while at < len(data):
            n = rng.randint(1, 3)
            out.append(s.feed(data[at : at + n]))
            at += n
        out.append(s.feed(b"", end=True))
        assert "".join(out) == codecs.decode(data, "utf-8", "replace")


# 9


@pytest.mark.parametrize("cell,chunk", [(100.0, 4096), (4.0, 4096), (0.5, 7)])
def test_embedding_links_against_all_pairs(spark, monkeypatch, cell, chunk):
    monkeypatch.setattr(embedding_dedup, "PIVOT_STEP", cell)
    monkeypatch.setattr(embedding_dedup, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 5)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(25, 6))
    rows = []
    for i in range(220):
        v = base[i % 25] + rng.normal(size=6) * 0.35 * (i % 3)
        rows.append((i, v.tolist() if i % 11 else base[0].tolist(), None if i % 40 == 0 else i % 2))
    rows += [(300, None, 1), (301, [0.0] * 6, 1), (302, [float("nan")] * 6, 1), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (304, [float("inf")] + [0.0] * 5, 1), (305, base[0, :3].tolist(), 0), (306, [1e300] * 6, 1), (307, [2e-300] * 6, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("x"))

    def ok(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, embedding_dedup.unit(np.array([v]))[0], y) for i, v, y in rows if y is not None and ok(v)]
    links = [(a, b) for k, (b, w, y) in enumerate(good) for a, v, x in good[:k] if x == y and len(v) == len(w) and v @ w >= 0.93]
    degree = defaultdict(int)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = brute_components([r[0] for r in rows], links)
    got = {r.vec_id: r for r in embedding_dedup.link(df).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert {k: r.n_links for k, r in got.items()} == {r[0]: degree[r[0]] for r in rows}
    assert all(r.kept == (k == r.component_id) for k, r in got.items())


def test_embeddings_have_several_pivots(spark, small):
    good = embedding_dedup.valid_rows(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("m")).select("label", F.size("embedding").alias("dim"), "node", "m", "embedding")
    assert embedding_dedup.pivots(nodes).where("size(pivots) > 1").count() > 0
    placed = embedding_dedup.placed(nodes, 0.93)
    assert placed.where("home").count() == nodes.count() < placed.count()


# 10


def test_licences_with_more_clauses_are_others(spark):
    """What is no copyright statement stays in the text, so the licence is not a known one."""
    mit = dict(license_scan.KNOWN)["MIT"]
    more = ["c) You may not use this software commercially.", "(c) The licensee pays a fee.", "All rights reserved; commercial use is forbidden.", "Copyright 2020 Someone. You may not sell it.", "© You must not copy."]
    texts = [mit + "\n" + m for m in more] + [m + "\n" + mit for m in more] + [f"(c) 2020 Someone\n© 2021\nAll Rights Reserved.\n{mit}"]
    got = {r.doc_id: r.license for r in license_scan.scan(docs_frame(spark, texts), license_scan.known_digests(spark)).collect()}
    assert got == {i: None for i in range(2 * len(more))} | {2 * len(more): "MIT"}


def test_licences_in_other_spelling(spark):
    mit = dict(license_scan.KNOWN)["MIT"]
    texts = [mit, "MIT Licence\n\nCopyright (c) 2020 Someone\n(c) 2021 Else\n\n" + mit.upper().replace("\n\n", "\n * "), mit + " more", None, "", "Copyright 2020 only", "x" * 100_000, mit.replace("sublicense", "sub-license")]
    got = {r.doc_id: r.license for r in license_scan.scan(docs_frame(spark, texts), license_scan.known_digests(spark)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: None, 7: "MIT"}


def test_licences_wrapped_at_any_width(spark):
    """A line of a licence may start with copyright notice or holders; only copyright statements are no part of it."""
    heads = ["", "Copyright (c) 2020 Someone\n", "copyright notice: 2020 Someone\r\n", " * Copyright Someone\n * All rights reserved.\n", "Copyright 2021, the authors\n"]
    texts, want = [], []
    for k, (name, text) in enumerate(license_scan.KNOWN):
        for width in range(20, 101):
            wrapped = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for x in text.split("\n\n"))
            texts.append(heads[(k + width) % len(heads)] + wrapped)
            want.append(name)
    got = {r.doc_id: r.license for r in license_scan.scan(docs_frame(spark, texts), license_scan.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == want


# pipeline


def test_pipeline_stages(spark, small):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{small}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, small)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id for r in seen.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            judged = toxicity.judge(seen, spark.read.parquet(f"{small}/labels.parquet")).where("predicted = 0")
            assert after == {r.doc_id for r in judged.collect()}
        elif name == "ngram_join":
            texts = {r.doc_id: shingles(r.text) for r in seen.select("doc_id", "text").collect()}
            ids = sorted(texts)
            links = [(a, b) for j, b in enumerate(ids) for a in ids[:j] if texts[a] and texts[b] and 100 * len(texts[a] & texts[b]) >= 75 * len(texts[a] | texts[b])]
            roots = brute_components(ids, links)
            assert after == {i for i in ids if roots[i] == i}
        else:
            hits = decontaminate.find(seen, spark.read.parquet(f"{small}/benchmark.parquet"))
            assert after == before - {r.doc_id for r in hits.collect()}
        seen = spark.createDataFrame(out.collect(), docs.schema)
    whole = {r.doc_id: r for r in p.run(spark, small).collect()}
    assert {k: r.text for k, r in whole.items()} == {r.doc_id: r.text for r in seen.collect()}


def test_pipeline_on_odd_rows(spark, small, tmp_path):
    import corpus_pipeline as p

    a, b = "one two three four five six seven eight", "some other words stand in this text here"
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    rows = [(1, a), (1, a), (5, a), (5, b), (None, a), (None, "a text of its own without any id"), (8, None), (9, ""), (10, " \n"), (None, None), (11, "so " + item + " and on")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_shingles int, score double, stays string"
    docs = spark.createDataFrame([(*r, "en", "s", 1, 2, 0.5, "x") for r in rows], schema)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.text) for r in p.run(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (None, rows[5][1]), (8, ""), (9, ""), (10, " \n"), (None, "")], key=repr)
    seen = docs
    for _, stage in p.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []


def test_shingles_do_not_depend_on_the_batch():
    texts = ["a b c d e f", "x", None, "A b c d e f g"]
    one = [s.tolist() for s in shingle_sets(pa.array(texts))]
    assert one == [next(shingle_sets(pa.array([t], pa.string()))).tolist() for t in texts]
    assert set(one[0]) < set(one[3])
