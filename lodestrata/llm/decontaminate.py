"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is short and a document long, so their Jaccard similarity is tiny and containment of the item is what counts.
Items are partitioned by the size of their shingle set into classes [2^(c-1), 2^c), each with an index of its own. An item's
signature is its smallest hashes under one random order, as many as any item of its class may miss at the threshold, plus
one: an item that is contained keeps at least one of them in the document. A document's signature for a class is all its
hashes up to the largest minimum of the class. Signatures that share a minimum make a pair, which is verified on the whole
sets. So the search loses nothing, documents are not shuffled, and items come in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_tables, lean, release, slices, string_buffer, table, written
from ._shingles import WIDTH, shingle_sets, short_hash, windows, word_hashes

THRESHOLD_PERCENT = 75
#: Shingles of test items that are sent to the executors at once (8 bytes each); more items make more passes.
BLOCK_SHINGLES = 1 << 20
_SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"


def needed(size: int, percent: int) -> int:
    """The fewest shared shingles at which an item of this size counts as contained."""
    return -(-size * percent // 100)


def signature_length(size: int, percent: int) -> int:
    """Minima that items of this size's class need so that a contained one keeps at least one."""
    top = (1 << int(size).bit_length()) - 1
    return min(size, top - needed(top, percent) + 1)


class SizeClass:
    """The items of one size class: an index from their minima to them, and the bar under which documents keep hashes."""

    def __init__(self, items: list[int], minima: list[np.ndarray]):
        keys = np.concatenate(minima)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.of = np.repeat(items, [len(m) for m in minima])[order]
        self.bar = self.keys[-1]
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.keys >> self.shift] = True

    def candidates(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in hashes, item) wherever a hash of the signature is a minimum of an item."""
        signature = np.flatnonzero(hashes <= self.bar)
        at = signature[self.seen[hashes[signature] >> self.shift]]
        low, high = np.searchsorted(self.keys, hashes[at], "left"), np.searchsorted(self.keys, hashes[at], "right")
        n = high - low
        first = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else low
        return np.repeat(at, n), self.of[first + np.arange(n.sum())]


class Items:
    """A block of test items: their sets, and an index for each size class."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        members: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            members.setdefault(len(s).bit_length(), []).append(k)
        self.classes = {c: SizeClass(ks, [sets[k][: signature_length(len(sets[k]), percent)] for k in ks]) for c, ks in sorted(members.items())}

    def search(self, column: pa.Array):
        """(row, item, shared shingles) of each text and each item that it contains."""
        data, offsets = string_buffer(column)
        words, at = word_hashes(data, offsets)
        hashes = windows(words, at)
        pairs: set[tuple[int, int]] = set()
        for size_class in self.classes.values():
            pos, item = size_class.candidates(hashes)
            owner = np.searchsorted(at, pos, "right") - 1
            whole = pos + WIDTH <= at[owner + 1]
            pairs.update(zip(owner[whole].tolist(), item[whole].tolist()))
        count = np.diff(at)
        short = np.flatnonzero((count > 0) & (count < WIDTH))
        if len(short) and 1 in self.classes:  # one shingle, which only items of one shingle can share
            pos, item = self.classes[1].candidates(np.concatenate([short_hash(words[at[row] : at[row + 1]]) for row in short.tolist()]))
            pairs.update(zip(short[pos].tolist(), item.tolist()))
        got, row_set = None, None
        for row, k in sorted(pairs):
            if row != got:
                got, row_set = row, np.unique(hashes[at[row] : at[row + 1] - WIDTH + 1]) if count[row] >= WIDTH else short_hash(words[at[row] : at[row + 1]])
            shared = int(np.isin(self.sets[k], row_set, assume_unique=True).sum())
            if shared >= needed(len(self.sets[k]), self.percent):
                yield row, k, shared


def item_sets(benchmark: DataFrame) -> DataFrame:
    """item_id, n and the sorted hashes (binary) of each item that has words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                sets = list(shingle_sets(part.column(1)))
                cols = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["item_id", "n", "hashes"])

    own = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text")
    return own.mapInArrow(lean(run), "item_id long, n long, hashes binary").where("n > 0")


def item_blocks(benchmark: DataFrame, percent: int):
    """All test items as blocks of about BLOCK_SHINGLES shingles, each fetched only when it is used."""
    items = written(item_sets(benchmark), "items")
    total = items.agg(F.sum("n")).first()[0] or 0
    n = -(-total // BLOCK_SHINGLES)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "hashes"), F.lit(n)) == k).orderBy("item_id").collect()
        yield Items([r.item_id for r in rows], [np.frombuffer(r.hashes, np.uint64) for r in rows], percent)


def find(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of every document that holds at least `percent` of an item.

    Shingles are those of five words; a text of fewer words is one shingle, so such an item matches only a text that equals
    it word by word. Null, empty and blank texts on either side match nothing. Repeated documents and items give repeated
    pairs, null ids stay null, other columns are not read, and an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = None
    for items in item_blocks(benchmark, percent):

        def run(batches, items=items):
            for batch in batches:
                for part in slices(batch, 1):
                    found = list(items.search(part.column(1)))
                    ids = part.column(0).to_pylist()
                    sizes = [len(items.sets[k]) for _, k, _ in found]
                    cols = [pa.array([ids[r] for r, _, _ in found], pa.int64()), pa.array([items.ids[k] for _, k, _ in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array([n for _, _, n in found], pa.int64()), pa.array([n / m for (_, _, n), m in zip(found, sizes)], pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        hits = own.mapInArrow(lean(run), _SCHEMA)
        out = hits if out is None else out.unionAll(hits)
    return spark.createDataFrame([], _SCHEMA) if out is None else out


def _holds(items: Items):
    """A column function: whether a text holds any of the items."""

    @F.arrow_udf("boolean")
    def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_tables()
        for column in columns:
            hit, base = np.zeros(len(column), bool), 0
            for part in slices(pa.RecordBatch.from_arrays([column], names=["text"]), 0):
                for row, _, _ in items.search(part.column(0)):
                    hit[base + row] = True
                base += part.num_rows
            yield pa.array(hit)
        release()

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs, all columns, that hold no test item; rules as for `find`."""
    for items in item_blocks(benchmark, percent):
        docs = docs.where(~_holds(items)(F.col("text").cast("string")))
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def sql_shingles(id_: str, table_: str) -> str:
    """DuckDB: a row for each text and distinct shingle, columns id and s."""
    return f"""SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, len(w) - {WIDTH - 2})] END) AS s
  FROM (SELECT {id_} AS id, {_WORDS} AS w FROM {table_})"""


SQL = f"""
WITH d AS ({sql_shingles("doc_id", "documents")}), b AS ({sql_shingles("item_id", "benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
m AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, shared AS n_shared, shared / n AS containment
FROM m JOIN n ON n.id = m.item_id WHERE 100 * shared >= {THRESHOLD_PERCENT} * n
"""
