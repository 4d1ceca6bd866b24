"""N-gram Jaccard join by count-vector R-trees: documents as sets of five-word shingles, linked at a Jaccard of 0.75 or more.

1. Equal sets become one node, so copies cost nothing later.
2. Shingles are hashed into GROUPS groups; a node's group counts are its point. The sum of coordinate minima of two points
   bounds their overlap from above.
3. Nodes that can link share a shingle among the first quarter of each one's shingles, in any one order of all shingles
   (rare ones first here). Nodes with a shingle there form a block; blocks lose no pair.
4. Blocks of the same nodes count as one. Each node first tries one partner, the smallest node of a block, of these the one
   it meets in most blocks; so a block of m near copies costs m pairs, not m*m. The links found give first components.
5. Every block that still holds several components builds an R-tree over its points and joins it with itself: boxes whose
   bound is too low are cut off, as are boxes within one component. Of the pairs found, those of a spanning forest of highest
   bounds over the components of a block are tried, so k components try fewer than k pairs and not k*k. Nodes of pairs kept
   back, and no others, are joined again, first under the bound of the fine points, then under that of the sharp points; each
   component tries ever more of its best pairs there, until none is kept back.

The fine point counts about two shingles a group, a quarter of the bytes of the sharp one, and tells long texts apart that are
alike in few groups.
The sharp point of a set of up to PRINTS shingles is the last 16 bits of each, which bound an overlap to nearly its value; that
of a larger set counts about four shingles a group. A pair that is tried passes this bound, then the exact sets of 64-bit
hashes decide. Two different shingles of a pair of n each have one hash with odds of n * n / 2^64
(2 in 10^11 for texts of 20,000 words), and the pair must lie within one shingle of the threshold for it to matter.

Very frequent shingles are known from counts over all documents; their blocks are salted, and large blocks of step 5 are cut
into chunks that meet pairwise in tasks of their own. Nodes with very many pairs are salted too. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import drop, lean, table, written
from ._components import components
from ._shingles import mix, sets_of

THRESHOLD_PERCENT = 75
GROUPS = 512
#: Shingles counted together in a task; those met fewer than LOCAL_MIN times there do not count as frequent.
COUNT_WINDOW = 1 << 21
LOCAL_MIN = 3
FREQUENT_MIN = 24
#: At most so many frequent shingles are sent to the executors (16 bytes each); the bar rises until they fit.
FREQUENT_MAX = 1 << 17
SALT_ROWS = 4096
CHUNK_ROWS = 2048
LEAF = 32
#: Box pairs of the tree that are opened at once.
OPEN_PAIRS = 256
#: Pairs of a node beyond which its row is sent once for every so many of them.
PAIRS_A_SALT = 64
#: Beyond a spanning forest, a component tries so many times more of its best pairs in each round from the fourth on.
MORE_PAIRS = 16
#: The largest set whose sharp point has 16 bits of each shingle.
PRINTS = 1 << 16
#: Distinct prints of a block that are laid out as bits at once.
PRINT_COLUMNS = 4096
#: Group counts of pairs that are compared at once.
COUNTS_AT_ONCE = 1 << 20
#: Nodes whose sets and points are fetched by a broadcast of ids (16 bytes each); more are fetched by a shuffled join.
BROADCAST_NODES = 1 << 18


def least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shared elements of two sets of `total` elements together at which they link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def node_of(hashes: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def point(hashes: np.ndarray, groups: int) -> bytes:
    """Group counts in the narrowest integers that hold them all (1, 2 or 4 bytes: the length tells which)."""
    c = np.bincount((hashes & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return c.astype("u1" if c.max() < 1 << 8 else "<u2" if c.max() < 1 << 16 else "<u4").tobytes()


def counts_of(raw, groups: int) -> np.ndarray:
    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // groups])


def fine_groups(n: int) -> int:
    """Groups for the fine point of a set of n: about four shingles a group, a power of two, so that points of different sizes fold."""
    return max(GROUPS, 1 << max(0, (n // 4 - 1)).bit_length())


def sharp_point(hashes: np.ndarray) -> bytes:
    n = len(hashes)
    return np.sort(hashes.astype("<u2")).tobytes() if n <= PRINTS else point(hashes, fine_groups(n))


def fine_point(n: int, sharp: bytes) -> bytes:
    """Group counts of a set of n, from its sharp point: about two shingles a group."""
    return sharp if n > PRINTS else point(np.frombuffer(sharp, "<u2").astype(np.uint64), fine_groups(2 * n))


def fine_counts(n: int, fine: bytes) -> np.ndarray:
    return counts_of(fine, fine_groups(n if n > PRINTS else 2 * n))


def shared_counts(counts: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """overlap_bound of the points at places a and b."""
    width, out = np.array([len(x) for x in counts]), np.zeros(len(a), np.int64)
    least = np.minimum(width[a], width[b])
    for groups in np.unique(least).tolist():
        at = np.flatnonzero(least == groups)
        own, place = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
        folded = np.empty((len(own), groups), np.uint16 if max(int(counts[k].sum()) for k in own) < 1 << 16 else np.uint32)
        for row, k in zip(folded, own):
            row[:] = counts[k].reshape(-1, groups).sum(0)
        x, y, step = place[: len(at)], place[len(at) :], max(1, COUNTS_AT_ONCE // groups)
        for k in range(0, len(at), step):
            part = slice(k, k + step)
            out[at[part]] = np.minimum(folded[x[part]], folded[y[part]]).sum(1, dtype=np.int64)
    return out


def prints_of(raw) -> np.ndarray:
    """The 16 bits of each shingle, each with the number of equal ones before it, so that shared ones count as often as in both."""
    x = np.frombuffer(raw, "<u2").astype(np.uint32)
    at = np.arange(len(x), dtype=np.uint32)
    first = np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1])[: len(x)], at, 0))
    return x | (at - first) << np.uint32(16)


def sharp_bound(n: int, x: bytes, m: int, y: bytes) -> int:
    """What two sets of n and m shingles with these sharp points can share at most."""
    if max(n, m) <= PRINTS:
        return len(np.intersect1d(prints_of(x), prints_of(y), assume_unique=True))
    x, y = (np.bincount(np.frombuffer(v, "<u2") & (GROUPS - 1), minlength=GROUPS) if k <= PRINTS else counts_of(v, fine_groups(k)) for k, v in ((n, x), (m, y)))
    return overlap_bound(x, y)


def shared_prints(sharp: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """sharp_bound of the sets at places a and b, all of at most PRINTS shingles."""
    each = [prints_of(x) for x in sharp]
    row = np.repeat(np.arange(len(each)), [len(x) for x in each])
    column, times = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)[1:]
    often = times > 1
    keep, out = often[column], np.zeros(len(a), np.int64)
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(often.sum()), PRINT_COLUMNS):
        s, e = np.searchsorted(column, [low, low + PRINT_COLUMNS])
        there = np.zeros((len(each), PRINT_COLUMNS), bool)
        there[row[s:e], column[s:e] - low] = True
        bits = np.packbits(there, axis=1).view("<u8")
        for k in range(0, len(a), 1 << 12):
            part = slice(k, k + (1 << 12))
            out[part] += np.bitwise_count(bits[a[part]] & bits[b[part]]).sum(1, dtype=np.int64)
    return out


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The sum of coordinate minima, after folding the finer point to the groups of the other."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    x, y = x.astype(np.int64), y.astype(np.int64).reshape(-1, len(x)).sum(0)
    return int(np.minimum(x, y).sum())


def as_pair(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and two hashes that name the text among rows of one id."""
    return as_pair(docs).select("doc_id", "text", *text_keys(F.col("text")))


def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def profiles(docs: DataFrame, seed: int) -> DataFrame:
    """A row for each document (doc_id, text hashes, n, node, check, coarse and sharp point), and rows (key, times) of shingles
    met often in one task."""
    schema = "doc_id long, k1 long, k2 long, n long, node long, check long, point binary, sharp binary, key long, times long"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]

    def run(batches):
        held, size = [], 0

        def counted():
            keys, times = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
            often = times >= LOCAL_MIN
            n = int(often.sum())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(n, t) for t in types[:8]] + [pa.array(keys[often].view(np.int64)), pa.array(times[often])], names=names)

        for batch in batches:
            for part, sets in sets_of(batch):
                nodes = [node_of(s, seed) if len(s) else (None, None) for s in sets]
                m = len(sets)
                cols = [part.column(0), part.column(2), part.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in nodes], pa.int64()), pa.array([b for _, b in nodes], pa.int64())]
                cols += [pa.array([point(s, GROUPS) if len(s) else None for s in sets], pa.binary()), pa.array([sharp_point(s) if len(s) else None for s in sets], pa.binary())]
                cols += [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
                held += sets
                size += sum(map(len, sets))
                if size >= COUNT_WINDOW:
                    yield counted()
                    size = 0
        yield counted()

    return keyed(docs).mapInArrow(lean(run), schema)


def frequent_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ascending hashes of frequent shingles and their counts."""
    sums, bar = written(counts.groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT_MIN), "frequent"), FREQUENT_MIN
    while sums.where(F.col("times") >= bar).count() > FREQUENT_MAX:
        bar *= 2
    rows = sums.where(F.col("times") >= bar).toPandas()
    drop(sums)
    keys = rows["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], rows["times"].to_numpy(np.int64)[order]


def prefix_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], percent: int, seed: int) -> DataFrame:
    """key, salt, node: the rare-first prefix of each document's shingles. Large blocks of frequent shingles have salts from 1 on."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        keys, times = shared.value
        salts = -(-times // SALT_ROWS)
        for batch in batches:
            for _, sets in sets_of(batch):
                all_keys, all_salts, nodes, lengths = [], [], [], []
                for s in sets:
                    if not len(s):
                        continue
                    p, node = prefix_length(len(s), percent), node_of(s, seed)[0]
                    at = np.searchsorted(keys, s) if len(keys) else np.zeros(len(s), np.int64)
                    hot = keys[np.minimum(at, len(keys) - 1)] == s if len(keys) else np.zeros(len(s), bool)
                    rare = s[~hot]
                    if len(rare) >= p:
                        own, salt = rare[:p], np.zeros(p, np.int64)
                    else:
                        where = at[hot]
                        where = where[np.lexsort((keys[where], times[where]))][: p - len(rare)]
                        own = np.concatenate([rare, keys[where]])
                        salt = np.concatenate([np.zeros(len(rare), np.int64), np.where(salts[where] > 1, 1 + int(mix(np.array([node]).view(np.uint64))[0] >> np.uint64(40)) % salts[where], 0)])
                    all_keys.append(own)
                    all_salts.append(salt)
                    nodes.append(node)
                    lengths.append(p)
                if nodes:
                    cols = [np.concatenate(all_keys).view(np.int64), np.concatenate(all_salts).astype(np.int32), np.repeat(np.array(nodes), lengths)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "salt", "node"])

    return as_pair(docs).mapInArrow(lean(run), "key long, salt int, node long")


def blocks(rows: DataFrame) -> DataFrame:
    """key, node of the prefix rows, once each, without those of nodes that are alone in their block."""

    def run(batches):
        last = None  # key, salt and node of the last row; whether it is already out
        for batch in batches:
            key, salt, node = (np.asarray(batch.column(i)) for i in range(3))
            if last is not None:
                key, salt, node = np.append(last[0], key), np.append(last[1], salt), np.append(last[2], node)
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (node[1:] != node[:-1])
            key, salt, node = key[fresh], salt[fresh], node[fresh]  # one row for a node, however many copies it has
            same = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
            member = np.append(same, False) | np.append(False, same) | (salt > 0)
            out = member.copy()
            if last is not None and last[3]:
                out[0] = False
            last = (key[-1], salt[-1], node[-1], bool(member[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(node[out])], names=["key", "node"])

    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "node")
    return dealt.mapInArrow(lean(run), "key long, node long")


def with_side(pairs: DataFrame, side: str, values: DataFrame, how: str = "inner") -> DataFrame:
    """pairs, joined with the values (node and other columns, to which the side's name is added) of their column `side`.

    A node in very many pairs is met by salted copies of its row, one for every PAIRS_A_SALT pairs, so no task gets them all.
    """
    named = values.select(*[F.col(c).alias(side if c == "node" else f"{c}_{side}") for c in values.columns])
    salts = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_A_SALT).cast("int").alias("salts"))
    copies = salts.join(named, side, how).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    dealt = pairs.join(salts.where("salts > 1"), side, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("a", "b"), "salts"), F.lit(0)).cast("int")).drop("salts")
    return dealt.join(copies.drop("salts"), [side, "salt"]).drop("salt")


def wanted_nodes(nodes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of nodes, whose points are large, that ids (node) name, and the table of ids, to be dropped after their use."""
    ids = written(ids.distinct(), "ids")
    return nodes.join(F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids, "node", "left_semi"), ids


def fine_points(nodes: DataFrame) -> DataFrame:
    """node, n, point and the fine point."""

    def run(batches):
        for batch in batches:
            fine = [fine_point(n, x) for n, x in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fine, pa.binary())], names=["node", "n", "point", "fine"])

    return nodes.select("node", "n", "point", "sharp").mapInArrow(lean(run), "node long, n long, point binary, fine binary")


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sharp points allow enough overlap."""

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist())
            low = [sharp_bound(n, x, m, y) for n, m, x, y in sizes]
            yield batch.select([0, 1]).filter(pa.array(np.array(low, np.int64) >= least_overlap(size, percent)))

    values, ids = wanted_nodes(nodes.select("node", "n", "sharp"), pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")))
    both = with_side(with_side(pairs.select("a", "b"), "b", values), "a", values)
    near = written(both.select("a", "b", "n_a", "n_b", "sharp_a", "sharp_b").mapInArrow(lean(run), "a long, b long"), "pairs")
    drop(ids)
    return near


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, seed: int) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets link. nodes: node, doc_id of a document that has it."""
    wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct().join(nodes, "node").select("doc_id", F.col("node").alias("wanted"))
    wanted = written(wanted, "wanted")
    small = wanted.count() <= BROADCAST_NODES

    def sets(batches):
        for batch in batches:
            for part, found in sets_of(batch):
                keep = [(k, s) for k, s, w in zip(range(len(found)), found, part.column(2).to_pylist()) if len(s) and node_of(s, seed)[0] == w]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(2)[k].as_py() for k, _ in keep], pa.int64()), pa.array([s.tobytes() for _, s in keep], pa.binary())], names=["node", "hashes"])

    held = as_pair(docs).join(F.broadcast(wanted) if small else wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(lean(sets), "node long, hashes binary").dropDuplicates(["node"])
    held = written(held, "sets")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(len(np.intersect1d(x, y, assume_unique=True)) >= least_overlap(len(x) + len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    both = with_side(with_side(pairs, "b", held), "a", held)
    links = written(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(lean(run), "a long, b long"), "links")
    drop(wanted, held)
    return links


class RTree:
    """Points packed bottom-up, by size and then by coordinates, into boxes of LEAF; a box keeps the maxima of its points."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        m = len(points)
        slab = max(1, int(np.ceil(np.sqrt(m / LEAF)))) * LEAF
        order = np.argsort(sizes, kind="stable")
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        self.order = np.lexsort((points[:, 2], points[:, 1], points[:, 0], rank // slab))
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order], groups[self.order], groups[self.order])]
        while len(self.levels[-1][0]) > 1:
            top, low, high, g_low, g_high = self.levels[-1]
            cut = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.minimum.reduceat(g_low, cut), np.maximum.reduceat(g_high, cut)))

    def passing(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of boxes (or points, on level 0) that may hold a link between different groups, and their bounds."""
        top, low, high, g_low, g_high = self.levels[level]
        ok = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a]) & ~((g_low[a] == g_high[a]) & (g_low[b] == g_high[b]) & (g_low[a] == g_low[b]))
        if not level:
            ok &= a != b
        a, b = a[ok], b[ok]
        bound = np.zeros(len(a), np.int64)
        for s in range(0, len(a), 1 << 12):
            bound[s : s + (1 << 12)] = np.minimum(top[a[s : s + (1 << 12)]], top[b[s : s + (1 << 12)]]).sum(1, dtype=np.int64)
        keep = bound >= least_overlap(low[a] + low[b], percent)
        return a[keep], b[keep], bound[keep]

    def pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index pairs of points of different groups that the bound lets through, and the bound over both sizes. Box pairs are
        opened depth first, a bounded number at a time."""
        root = len(self.levels) - 1
        found, todo = [(np.zeros(0, np.int64),) * 3], [(root, *self.passing(root, np.zeros(1, np.int64), np.zeros(1, np.int64), percent))]
        k = np.arange(LEAF)
        while todo:
            level, a, b, bound = todo.pop()
            if not level:
                found.append((a, b, bound))
                continue
            if len(a) > OPEN_PAIRS:
                todo.append((level, a[OPEN_PAIRS:], b[OPEN_PAIRS:], bound[OPEN_PAIRS:]))
            c = ((a[:OPEN_PAIRS, None] * LEAF + k)[:, :, None] + np.zeros(LEAF, np.int64)).ravel()
            d = ((b[:OPEN_PAIRS, None] * LEAF + k)[:, None, :] + np.zeros((LEAF, 1), np.int64)).ravel()
            below = len(self.levels[level - 1][0])
            ok = (c < below) & (d < below) & (c <= d)
            todo.append((level - 1, *self.passing(level - 1, c[ok], d[ok], percent)))
        a, b, bound = (np.concatenate(x) for x in zip(*found))
        sizes = self.levels[0][1]
        return self.order[a], self.order[b], bound / (sizes[a] + sizes[b])


def first_of_each(score: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """The places of the `most` highest scores of each (x, y)."""
    order = np.lexsort((-score, y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    begin = np.flatnonzero(new)
    return order[np.arange(len(order)) - begin[np.cumsum(new) - 1] < most]


def tried_first(score: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Places of the pairs of groups (x, y) to try first: a spanning forest of the highest scores and, if `most` is more than 1,
    the `most` highest of each group. So k groups get at most k - 1 + k * most places."""
    best = first_of_each(score, np.minimum(x, y), np.maximum(x, y), 1)
    best = best[np.argsort(-score[best], kind="stable")]
    root, forest, left = {}, [], len(np.unique(np.concatenate([x, y]))) - 1
    for k, a, b in zip(best.tolist(), x[best].tolist(), y[best].tolist()):
        while (up := root.get(a, a)) != a:
            root[a] = a = root.get(up, up)
        while (up := root.get(b, b)) != b:
            root[b] = b = root.get(up, up)
        if a != b:
            root[a] = b
            forest.append(k)
            left -= 1
            if not left:
                break
    if most == 1:
        return np.array(forest, np.int64)
    ends = np.concatenate([x, y])
    return np.union1d(forest, first_of_each(np.tile(score, 2), ends, np.zeros_like(ends), most) % len(x)).astype(np.int64)


def chunk_pairs(members: DataFrame) -> DataFrame:
    """key, i, j, node and group: the members of each block, those of large blocks by chunks that meet pairwise. members: key,
    node, group, m (rows of the block)."""
    chunks = F.ceil(F.col("m") / CHUNK_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    other = F.explode(F.when(chunks <= 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1)))
    spread = members.withColumn("own", own).withColumn("other", other)
    return spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "group")


def tree_pairs(members: DataFrame, points: DataFrame, percent: int, most: int) -> DataFrame:
    """Candidate pairs (a, b), a < b, of different groups within the rows of each (key, i, j), and a row (key, i, j, node) for
    each node there of candidates kept back. members: of chunk_pairs. points: node, n, point, and fine or sharp if its bound counts too."""
    columns = ["key", "i", "j", "node", "group", *[c for c in points.columns if c != "node"]]
    rows = members.join(points, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    names, kinds = ["a", "b", "key", "i", "j", "node"], [pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def joined(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows)
        node, group, n = (t.column(c).to_numpy() for c in ("node", "group", "n"))
        ranked = np.unique(group, return_inverse=True)[1]
        if len(node) < 2 or not ranked.any():
            return
        points_ = np.stack([counts_of(x, GROUPS) for x in t.column("point").to_pylist()])
        x, y, score = RTree(points_, n.astype(np.int64), ranked).pairs(percent)
        if not len(x):
            return
        if "fine" in columns:
            shared = shared_counts([fine_counts(k, v) for k, v in zip(n.tolist(), t.column("fine").to_pylist())], x, y)
            keep = shared >= least_overlap(n[x] + n[y], percent)
            x, y, score = x[keep], y[keep], (shared / (n[x] + n[y]))[keep]
            if not len(x):
                return
        if "sharp" in columns:
            small = np.flatnonzero(n <= PRINTS)
            place, both = np.cumsum(n <= PRINTS) - 1, (n[x] <= PRINTS) & (n[y] <= PRINTS)
            size, keep = n[x] + n[y], np.ones(len(x), bool)
            if both.any():
                shared = shared_prints([t.column("sharp")[k].as_py() for k in small.tolist()], place[x[both]], place[y[both]])
                score[both], keep[both] = shared / size[both], shared >= least_overlap(size[both], percent)
            x, y, score = x[keep], y[keep], score[keep]
            if not len(x):
                return
        x, y = np.minimum(x, y), np.maximum(x, y)  # rows are ordered by node
        order = np.lexsort((y, x))  # of equal scores the same pair first in all blocks
        x, y, score = x[order], y[order], score[order]
        best = tried_first(score, ranked[x], ranked[y], most)
        yield pa.RecordBatch.from_arrays([pa.array(node[x[best]]), pa.array(node[y[best]])] + [pa.nulls(len(best), k) for k in kinds], names=names)
        left = np.delete(np.arange(len(x)), best)
        if len(left):
            own = node[np.unique(np.concatenate([x[left], y[left]]))]
            cell = [pa.array([t.column(c)[0].as_py()] * len(own), k) for c, k in zip(names[2:], kinds)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64())] * 2 + cell[:3] + [pa.array(own)], names=names)

    def run(batches):
        held, last = [], None
        for batch in batches:
            key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("key", "i", "j")], 1)
            cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for a, b in zip(cut, cut[1:]):
                if b > a:
                    if last is not None and last != key[a].tolist():
                        yield from joined(held)
                        held = []
                    last = key[a].tolist()
                    held.append(batch.slice(a, b - a))
        if held:
            yield from joined(held)

    return rows.select(columns).mapInArrow(lean(run), "a long, b long, key long, i int, j int, node long")


def same_nodes() -> list[Column]:
    """What tells groups of different nodes apart: their number and two sums of hashes."""
    sums = [F.sum(F.xxhash64(*salt, "node").cast("decimal(38,0)")) for salt in ([], [F.lit(1)])]
    return [F.count("*").alias("m"), sums[0].alias("s1"), sums[1].alias("s2")]


def linked_rows(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2 (hashes of the text), n and node (null without words) of every row; and node and component."""
    seed = 0
    while True:
        both = written(profiles(docs, seed), "profiles")
        groups = both.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("point").alias("point"), F.min("sharp").alias("sharp"), F.min("check").alias("low"), F.max("check").alias("high"))
        stored = written(groups, "nodes")
        if stored.where("low <> high").isEmpty():
            break
        drop(both, stored)
        seed += 1  # two sets had the same 64-bit name: name all anew
    nodes = stored.drop("low", "high")
    named = nodes.where("doc_id is not null").select("node", "doc_id")
    frequent = frequent_shingles(both.where("key is not null").select("key", "times"))
    rows = written(both.where("n is not null").select("doc_id", "k1", "k2", "n", "node"), "rows")
    drop(both)  # points are read from nodes only
    blocked = written(blocks(prefix_rows(docs, frequent, percent, seed)), "blocks")
    # blocks of the same nodes (by their number and two sums of hashes) need one search
    kinds = blocked.groupBy("key").agg(F.min("node").alias("first"), *same_nodes())
    kinds = written(kinds.where("m > 1").groupBy("m", "first", "s1", "s2").agg(F.min("key").alias("key"), F.count("*").alias("blocks")).select("key", "m", "first", "blocks"), "kinds")
    members = written(blocked.join(kinds, "key"), "members")
    drop(blocked, kinds)

    def check(pairs: DataFrame) -> DataFrame:
        near = bounded(pairs, nodes, percent)
        if near.isEmpty():
            return near
        links = verified(near, docs, named, percent, seed)
        drop(near)
        return links

    partners = members.where("node <> first").groupBy("node", "first").agg(F.sum("blocks").alias("blocks"))
    tried = partners.groupBy(F.col("node").alias("b")).agg(F.max_by("first", F.struct("blocks", -F.col("first"))).alias("a"))
    tried = written(tried.select("a", "b"), "tried")
    links = check(tried)
    found = components(links)
    again, tree, turn = None, None, 0
    while again is None or not again.isEmpty():
        grouped = written(members.join(found, "node", "left").select("key", "m", "node", F.coalesce("component", "node").alias("group")), "grouped")
        cell, cells = ["key"], grouped
        if again is not None:
            cell, cells = ["key", "i", "j"], written(chunk_pairs(grouped).join(again, ["key", "i", "j", "node"], "left_semi"), "cells")
            drop(grouped, tree)
        used = cells
        apart = cells.groupBy(*cell).agg(F.min("group").alias("low"), F.max("group").alias("high"), *([] if again is None else same_nodes())).where("low <> high")
        if again is not None:  # cells of the same nodes left hold the same candidates
            apart = apart.groupBy("m", "low", "high", "s1", "s2").agg(F.min(F.struct(*cell)).alias("cell")).select("cell.*")
        apart = apart.select(*cell)
        cells = cells.join(apart, cell)
        cells = chunk_pairs(cells) if again is None else cells
        if turn:
            own, ids = wanted_nodes(nodes, used.select("node"))
            points = fine_points(own) if turn == 1 else own.select("node", "n", "point", "sharp")
        else:
            points = nodes.select("node", "n", "point")
        # the first sharp turn tries a forest too; what it leaves apart is no link, but for the few whose prints agree by chance
        tree = written(tree_pairs(cells, points, percent, MORE_PAIRS ** max(0, turn - 2)), "tree")
        drop(used, *([ids] if turn else []))
        untried = written(tree.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        new = check(untried)
        if not new.isEmpty():
            links = links.unionAll(new)
            found = components(links)
        else:
            drop(new)
        tried, turn = tried.unionAll(untried), turn + 1
        again = tree.where("a is null").select("key", "i", "j", "node")
    named = written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "named")
    drop(tree, members, stored)
    return rows, named


def link(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document row.

    component_id is the smallest doc_id that links reach, the row's own included. A text of fewer than five words is one
    shingle. Null, empty and blank texts have no shingles and link with nothing. Rows of one id are judged each by its own
    text. A row without id takes the component of its text, which is null if no row with an id is in it. Other columns are
    not read, and an empty table gives an empty table.
    """
    rows, named = linked_rows(docs, percent)
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(named, "node")
    smallest = written(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    best = written(named.join(smallest, "component").select("node", "component_id"), "named")
    drop(named, smallest)
    result = rows.join(best, "node", "left")  # plain sides, so that the rows of a node with very many copies may be split
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs, all columns, with one row of each component: the one of the smallest doc_id.

    Rows are judged by id and text, so rows of one id with texts of different components each stay. Rows of the same id in one
    component are ordered by a hash of their text, rows without id come after all others, and of equal rows one stays. Rows
    without words are no one's copies and all stay. Other columns, whatever their names, are carried along.
    """
    rows, named = linked_rows(docs, percent)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2")
    first = rows.where("node is not null").groupBy("node").agg(F.min(order).alias("first")).join(named, "node")
    smallest = written(first.groupBy("component").agg(F.min("first").alias("best")), "best")
    best = written(named.join(smallest, "component").select("node", "best"), "named")
    drop(named, smallest)
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))
    judged = rows.join(best, "node").groupBy("doc_id", "k1", "k2").agg(F.bool_or(same).alias("stays"), F.count("*").alias("rows"))
    judged = written(judged.where("not stays or rows > 1"), "judged")
    drop(rows, best)
    small = judged.count() <= BROADCAST_NODES
    names = [f"__own{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    id_, text = (F.col(names[[c.lower() for c in docs.columns].index(c)]) for c in ("doc_id", "text"))
    own = own.withColumn("__id", id_.cast("long")).withColumns(dict(zip(("__k1", "__k2"), text_keys(text.cast("string")))))
    on = F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2"))
    marked = own.join(F.broadcast(judged) if small else judged, on, "left").where("stays is null or stays")
    if not judged.where("stays").isEmpty():  # equal rows: one of each stays
        place = F.row_number().over(Window.partitionBy("__id", "__k1", "__k2").orderBy("__k1"))
        again = marked.where("rows > 1").withColumn("__place", place).where("__place = 1").drop("__place")
        marked = marked.where("rows is null or rows = 1").unionByName(again)
    return marked.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))


def sql() -> str:
    from .decontaminate import sql_shingles

    return f"""
WITH RECURSIVE s AS MATERIALIZED ({sql_shingles("doc_id", "documents")}),
n AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * shared >= {THRESHOLD_PERCENT} * (x.n + y.n - shared)),
r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.id = d.doc_id JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = d.doc_id
"""
