"""Exact n-gram Jaccard join by set-relation skipping.

A document's set is its distinct word n-grams, as 64-bit hashes; documents with equal sets are
one node. A global order puts frequent n-grams last, and two sets that link must share an n-gram
within their prefixes (the first n - ceil(t n) + 1), so each prefix n-gram is a posting in that
n-gram's index list (its node, set size and position), and the lists are dealt over the cluster.

Index-level skipping: a list is sorted by set size; for an entry only the block of entries whose
size can reach the threshold is visited, and within it entries whose positions leave too few
n-grams before and behind are skipped, without looking at either set.

Answer-level skipping: in a list longer than ``SMALL_LIST`` each set is first compared with one
centre only. A set that links to the centre inherits the centre's answers: all members of one
component are reachable from each other, and their mutual pairs are never generated. Where lists
still hold several components, all entries of different components are compared, in blocks that
have the sets at hand, so no link between components is lost and only links leave a task. There a
set's answers (what it shares with every other set of the block) are derived from those of the most
similar set that has them already: only the n-grams in which the two differ are looked up.

Candidates are verified on the whole sets. Sets travel only for nodes that have a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, U64, Hasher, blocks, drop_table, edges_of, lean, materialize, mix, pack, release, row_key, shuffles_removed, unpack
from .graph import components, join_components

WORDS = 5
#: 100 * |x & y| >= PERCENT * |x | y|
PERCENT = 75
#: Lists up to this length give all their pairs at once.
SMALL_LIST = 8
#: Documents for each bucket of index lists.
BUCKET_DOCS = 1500
#: N-grams counted at a time, and bits of a counter's number within its bucket.
COUNT_GRAMS, COUNTER_BITS = 1 << 21, 22
#: Frequent n-grams (those in more than SMALL_LIST sets) that the global order tells apart.
MAX_FREQUENT = 1 << 20
#: Entries of a list that one task pairs with others.
PAIR_BLOCK = 2048
#: Turns in which open long lists get a centre, before their entries are compared in blocks.
TURNS = 1
#: Bits (as a power of two) of the broadcast Bloom filter over documents that have a candidate, and bits set by each. Its size is
#: the same for every input: the fuller it is, the more sets travel that no pair asks for.
BLOOM_BITS, PROBES = 26, 3
#: Sets of a block whose answers are at hand for others.
ANSWERS = 32
#: Postings a task holds before it deals them out.
FLUSH = 1 << 20


@dataclass
class Grams:
    """Hashing parameters: words per n-gram and the percentage of the threshold."""

    words: int = WORDS
    percent: int = PERCENT

    def __post_init__(self):
        self.hasher = None
        self.shared: frozenset[int] = frozenset()

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes sorted within each row and distinct there, and the cuts between rows."""
        self.hasher = self.hasher or Hasher()
        n = len(offsets) - 1
        starts, ends, row = edges_of(~IS_SPACE[data], offsets)
        word = self.hasher.runs(self.hasher.sums(data), starts, ends)
        count = np.bincount(row, minlength=n)
        k = self.words
        parts, owners = [], []
        if len(word) >= k:
            gram = word[: len(word) - k + 1].copy()
            for j in range(1, k):
                gram = gram * U64(0x9E3779B97F4A7C15) + word[j : len(word) - k + 1 + j]
            ok = row[: len(gram)] == row[k - 1 :]
            parts.append(mix(gram[ok]))
            owners.append(row[: len(gram)][ok])
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            first = np.cumsum(count) - count
            value = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = count[short] > j
                value[has] = value[has] * U64(0x9E3779B97F4A7C15) + word[first[short[has]] + j]
            parts.append(mix(value ^ count[short].astype(U64)))
            owners.append(short)
        if not parts:
            return np.zeros(0, U64), np.zeros(n + 1, np.int64)
        gram, owner = np.concatenate(parts), np.concatenate(owners)
        if len(short):
            order = np.argsort(owner, kind="stable")
            gram, owner = gram[order], owner[order]
        sort_rows(gram, np.searchsorted(owner, np.arange(n + 1)))
        keep = np.ones(len(gram), bool)
        keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        gram, owner = gram[keep], owner[keep]
        return gram, np.searchsorted(owner, np.arange(n + 1))

    def need(self, na, nb):
        """Common n-grams that two sets of these sizes need."""
        p = self.percent
        return -(-p * (na + nb) // (100 + p))

    def prefix(self, n):
        """Length of the prefix in which a link must show."""
        return n + (self.percent * n) // -100 + 1


def sort_rows(values: np.ndarray, cuts: np.ndarray) -> None:
    """Sort each row's values in place."""
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()


def node_id(grams: np.ndarray, shared: frozenset[int] = frozenset()) -> int:
    """Id of a set: documents with equal sets share it (0 is kept for the empty set).

    Ids in ``shared`` are known to be those of several different sets, which take their next one.
    """
    if not len(grams):
        return 0
    raw, seed = grams.tobytes(), 0
    while (found := int(np.int64(U64(_digest(raw, seed) | 1)))) in shared:
        seed += 1
    return found


def _digest(raw: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(raw, seed)


def _nodes(gram: np.ndarray, cuts: np.ndarray, shared: frozenset[int] = frozenset()) -> list[int]:
    return [node_id(gram[cuts[i] : cuts[i + 1]], shared) for i in range(len(cuts) - 1)]


def document_nodes(docs: DataFrame, grams: Grams) -> DataFrame:
    """doc_id, node, n_shingles of every document.

    A second hash of each set tells whether a node stands for one set only. Ids of several sets (about
    n^2 / 2^64 of n sets, hence a handful) are kept in ``grams``, and the documents numbered anew.
    """

    def run(batches):
        for rows, data, offsets in blocks(batches):
            gram, cuts = grams.sets(data, offsets)
            check = [_check(gram[cuts[i] : cuts[i + 1]]) for i in range(len(cuts) - 1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(_nodes(gram, cuts, grams.shared), pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array(check, pa.int64())], ["doc_id", "node", "n_shingles", "check"])

    while True:
        found = materialize(_texts(docs).mapInArrow(lean(run), "doc_id long, node long, n_shingles long, check long"))
        several = found.groupBy("node").agg(F.min(F.struct("n_shingles", "check")).alias("lo"), F.max(F.struct("n_shingles", "check")).alias("hi")).filter("lo <> hi").select("node").collect()
        if not several:
            return found.drop("check")
        grams.shared |= {r.node for r in several}


def _check(grams: np.ndarray) -> int:
    return int(np.int64(U64(xxhash.xxh64_intdigest(grams.tobytes(), 7))))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _counter(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Number of an n-gram's counter: its bucket, and a hash within it."""
    return ((gram >> U64(40)) % U64(buckets)).astype(np.int64) << COUNTER_BITS | (gram & U64((1 << COUNTER_BITS) - 1)).astype(np.int64)


def frequent(docs: DataFrame, grams: Grams, buckets: int) -> np.ndarray:
    """Counters of frequent n-grams, the most frequent last: their n-grams come last in the order.

    Counts cover all documents: each run of n-grams is counted in its task, the counters travel as
    packed gaps, and a bucket adds them up. Counters are hashes, and MAX_FREQUENT of them return:
    the order decides how much work is done, never the result.
    """

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            value, count = np.unique(_counter(np.concatenate(held), buckets), return_counts=True)
            bucket, slot = value >> COUNTER_BITS, value & ((1 << COUNTER_BITS) - 1)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = np.empty(b - a, _COUNTS)
                part["gap"], part["n"] = np.diff(slot[a:b], prepend=0), np.minimum(count[a:b], 65535)
                blobs.append(pack(part))
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "counts"])

        for _, data, offsets in blocks(batches):
            gram, cuts = grams.sets(data, offsets)
            for i, node in enumerate(_nodes(gram, cuts, grams.shared)):
                if node and node not in seen:
                    seen.add(node)
                    held.append(gram[cuts[i] : cuts[i + 1]])
                    size += cuts[i + 1] - cuts[i]
            if size >= COUNT_GRAMS:
                yield flush()
                held, size, seen = [], 0, set()
        if size:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        for blob in group.column("counts").to_pylist():
            part = unpack(blob, _COUNTS)
            total[np.cumsum(part["gap"], dtype=np.int64)] += part["n"]
        often = np.flatnonzero(total > SMALL_LIST)
        return pa.table({"counter": (group.column("bucket")[0].as_py() << COUNTER_BITS) + often, "n": total[often]})

    counts = _texts(docs).mapInArrow(lean(run), "bucket int, counts binary").groupBy("bucket").applyInArrow(lean(add), "counter long, n long")
    with shuffles_removed(docs.sparkSession):
        rows = counts.orderBy(F.desc("n"), "counter").limit(MAX_FREQUENT).toPandas()
    often = rows.sort_values(["n", "counter"]).counter.to_numpy(np.int64)
    del rows
    release()
    return often


class Order:
    """Maps n-gram hashes to their place in the global order: rare ones by hash, frequent ones last."""

    def __init__(self, often: np.ndarray, buckets: int):
        by = np.argsort(often)
        self.counter, self.place, self.buckets = often[by], by.astype(U64), buckets

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        out = gram >> U64(1)
        if len(self.counter) and len(gram):
            mine = _counter(gram, self.buckets)
            at = np.minimum(np.searchsorted(self.counter, mine), len(self.counter) - 1)
            hit = self.counter[at] == mine
            out[hit] = (U64(1) << U64(63)) | (self.place[at[hit]] << U64(40)) | (gram[hit] >> U64(24))
        return out


_COUNTS = np.dtype([("gap", "<u4"), ("n", "<u2")])
_LISTS = np.dtype([("token", "<u8"), ("node", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def postings(docs: DataFrame, grams: Grams, often: np.ndarray, buckets: int) -> DataFrame:
    """bucket, entries: packed postings of the prefixes of all distinct sets."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches):
        order, held, size = Order(shared.value, buckets), [], 0

        def flush():
            rows = np.concatenate(held)
            rows = rows[np.argsort(_bucket(rows["token"], buckets), kind="stable")]
            bucket = _bucket(rows["token"], buckets)
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[cuts[:-1]], pa.int32()), pa.array([pack(rows[a:b][np.argsort(rows["token"][a:b])]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
            ], ["bucket", "entries"])

        seen: set[int] = set()
        for _, data, offsets in blocks(batches):
            gram, cuts = grams.sets(data, offsets)
            owner = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            token = order(gram)
            sort_rows(token, cuts)
            pos = np.arange(len(token)) - cuts[owner]
            n = np.diff(cuts)
            node = np.array(_nodes(gram, cuts, grams.shared), np.int64)
            fresh = np.array([x != 0 and x not in seen and not seen.add(x) for x in node.tolist()], bool)
            keep = (pos < grams.prefix(n)[owner]) & fresh[owner]
            rows = np.empty(int(keep.sum()), _LISTS)
            rows["token"], rows["node"], rows["size"], rows["pos"] = token[keep], node[owner[keep]], n[owner[keep]], pos[keep]
            held.append(rows)
            size += len(rows)
            if size >= FLUSH:
                yield flush()
                held, size, seen = [], 0, set()
        if size:
            yield flush()

    return _texts(docs).mapInArrow(lean(run), "bucket int, entries binary")


def _bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(token) >> U64(33)) % U64(buckets)).astype(np.int32)


def _lists(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of lists with two nodes or more, by (token, size, node), and the cuts between lists."""
    rows = rows[np.argsort(rows["token"], kind="stable")]
    token = rows["token"]
    new = np.concatenate([[True], token[1:] != token[:-1], [True]])
    lone = new[:-1] & new[1:]
    rows = rows[~lone]
    rows = rows[np.lexsort((rows["node"], rows["size"], rows["token"]))]
    same = np.zeros(len(rows), bool)
    same[1:] = (rows["token"][1:] == rows["token"][:-1]) & (rows["node"][1:] == rows["node"][:-1])
    rows = rows[~same]
    token = rows["token"]
    cuts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(rows) else np.zeros(1, np.int64)
    return rows, cuts


def _bound(ki, pi, kj, pj, na, nb):
    """Most n-grams that two sets can share, given one they share at places pi and pj, when at most
    ki and kj of those before it come into question."""
    return np.minimum(ki, kj) + 1 + np.minimum(na - pi - 1, nb - pj - 1)


def _near(lists: pa.Table, grams: Grams) -> pa.Table:
    """Rows of kind 0: pairs of short lists; of kind 1: entries of long lists."""
    rows, cuts = _lists(np.concatenate([unpack(x, _LISTS) for x in lists.column("entries").to_pylist()]))
    size = np.diff(cuts)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, SMALL_LIST + 1):
        base = cuts[:-1][size == n]
        i, j = np.triu_indices(n, 1)
        left.append((base[:, None] + i).ravel())
        right.append((base[:, None] + j).ravel())
    long = np.repeat(size > SMALL_LIST, size)
    x, y = rows[np.concatenate(left)], rows[np.concatenate(right)]
    good = _bound(x["pos"], x["pos"], y["pos"], y["pos"], x["size"], y["size"]) >= grams.need(x["size"].astype(np.int64), y["size"])
    x, y = x[good], y[good]
    swap = x["node"] > y["node"]
    a, b = np.where(swap, y, x), np.where(swap, x, y)
    by = np.lexsort((b["node"], a["node"]))
    a, b = a[by], b[by]
    first = np.ones(len(a), bool)
    first[1:] = (a["node"][1:] != a["node"][:-1]) | (b["node"][1:] != b["node"][:-1])
    at = np.flatnonzero(first)
    n = np.diff(np.append(at, len(a)))
    fold = lambda v: np.maximum.reduceat(v, at) if len(at) else v
    pa_, pb_ = fold(a["pos"]), fold(b["pos"])
    a, b, held = a[at], b[at], rows[long]
    none = np.zeros(len(held), np.int32)
    columns = {
        "kind": (np.zeros(len(a)), np.ones(len(held))), "a": (a["node"], held["node"]), "b": (b["node"], held["token"].view(np.int64)),
        "na": (a["size"], held["size"]), "nb": (b["size"], none), "pa": (pa_, held["pos"]), "pb": (pb_, none), "n": (n, none),
    }
    return pa.table({c: np.concatenate(v).astype(np.int64 if c in "ab" else np.int32) for c, v in columns.items()})


_NEAR = "kind int, a long, b long, na int, nb int, pa int, pb int, n int"


def _first_pairs(near: DataFrame, grams: Grams) -> DataFrame:
    """Candidates of short lists.

    What a pair shares in short lists is counted in full; it may share as many more prefix n-grams
    as both have entries in long lists, and what follows the last shared place in the shorter rest.
    """
    pairs = near.filter("kind = 0").groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("n").alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    long = near.filter("kind = 1").groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.join(long.withColumnRenamed("k", "ka"), "a", "left").join(long.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b", "left")
    p = grams.percent
    hidden = F.least(F.coalesce("ka", F.lit(0)), F.coalesce("kb", F.lit(0)))
    most = F.col("n") + hidden + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return pairs.filter((100 + p) * most >= p * (F.col("na") + F.col("nb"))).select("a", "b")


def long_entries(near: DataFrame) -> DataFrame:
    """Entries of long lists: token, node, size, pos, and k, the node's long entries before this one.

    Pairs that share a short list are decided by it. Any other pair shares only n-grams of long
    lists in its prefixes, so of what stands before a shared one at most k n-grams can be shared.
    """
    long = near.filter("kind = 1").select(F.col("b").alias("token"), F.col("a").alias("node"), F.col("na").alias("size"), F.col("pa").alias("pos"))
    return long.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)


def open_entries(long: DataFrame, comp: DataFrame) -> DataFrame:
    """Entries (token, node, size, pos, k, comp) of long lists that still hold two components or more."""
    known = long.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    return known.join(mixed, "token")


def star_pairs(entries: DataFrame, turn: int, grams: Grams) -> DataFrame:
    """Each open list gets a centre (another one each turn); entries of other components are paired with it."""
    by = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp", "size", "pos", "k")
    centre = entries.groupBy("token").agg(F.min(by).alias("c"))
    found = entries.join(centre, "token").filter(F.col("comp") != F.col("c.comp"))
    p = grams.percent
    most = F.least("k", "c.k") + F.least(F.col("size") - F.col("pos"), F.col("c.size") - F.col("c.pos"))
    found = found.filter((100 + p) * most >= p * (F.col("size") + F.col("c.size")))
    return found.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


class Answers:
    """Of the sets of a block: how many n-grams one shares with every other.

    flat: numbers of the n-grams of all sets, ascending within each; start, count: where each set's are.
    """

    def __init__(self, flat: np.ndarray, start: np.ndarray, count: np.ndarray):
        self.flat, self.start, self.count = flat, start, count
        order = np.argsort(flat, kind="stable")
        self.owner = np.repeat(np.arange(len(count), dtype=np.int32), count)[order]
        self.cuts = np.searchsorted(flat[order], np.arange(int(flat.max()) + 2 if len(flat) else 1))
        self.known: dict[int, np.ndarray] = {}

    def grams(self, x: int) -> np.ndarray:
        return self.flat[self.start[x] : self.start[x] + self.count[x]]

    def _held(self, grams: np.ndarray) -> np.ndarray:
        """How many of ``grams`` each set holds, by their index lists."""
        lo, n = self.cuts[grams], self.cuts[grams + 1] - self.cuts[grams]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[at], minlength=len(self.count))

    def of(self, x: int) -> np.ndarray:
        mine = self.grams(x)
        # n-grams to look up: those of x, or those in which x differs from a set whose answers are known
        apart = {y: self.count[x] + self.count[y] - 2 * found[x] for y, found in self.known.items()}
        near = min(apart, key=apart.get, default=None)
        if near is None or apart[near] >= self.count[x]:
            found = self._held(mine)
        else:
            other = self.grams(near)
            found = self.known[near] + self._held(np.setdiff1d(mine, other, assume_unique=True)) - self._held(np.setdiff1d(other, mine, assume_unique=True))
        if len(self.known) >= ANSWERS:
            del self.known[next(iter(self.known))]
        self.known[x] = found
        return found


def _across(lists: pa.Table, sets: pa.Table, grams: Grams) -> pa.Table:
    """Links (a, b) between different components in one block of lists, enough to connect what links.

    A set is compared, on all n-grams, with those entries of its lists that size and places allow
    and that are in no common component with it by now; found links count at once, so the answers
    of a set's component need not be computed again.
    """
    if not lists.num_rows or not sets.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    names, node = np.unique(lists.column("node").to_numpy(), return_inverse=True)
    token, comp, size, pos, k, side = (lists.column(c).to_numpy() for c in ("token", "comp", "size", "pos", "k", "side"))
    by = np.lexsort((size, token))
    token, node, comp, size, pos, k, side = token[by], node[by], comp[by], size[by].astype(np.int64), pos[by].astype(np.int64), k[by].astype(np.int64), side[by]
    where = dict(zip(sets.column("s_node").to_pylist() if sets.num_rows else [], range(sets.num_rows)))
    at = np.array([where.get(x, -1) for x in names.tolist()])
    parts = [_keys(sets.column("grams")[int(i)].as_py()) if i >= 0 else np.zeros(0, U64) for i in at]
    count = np.array([len(x) for x in parts])
    flat = np.unique(np.concatenate(parts), return_inverse=True)[1].astype(np.int32)
    start = np.cumsum(count) - count
    answers = Answers(flat, start, count)
    label = np.zeros(len(names), np.int64)
    label[node] = comp
    own = bool((side == 2).all())  # a block with itself
    half, sizes = np.zeros(len(names), side.dtype), np.zeros(len(names), np.int64)
    half[node], sizes[node] = side, size
    # places of each node's entries, and the end of its size block in each list
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))
    low = np.repeat(edge[:-1], np.diff(edge))
    top = np.empty(len(token), np.int64)
    for lo, hi in zip(edge[:-1], edge[1:]):
        top[lo:hi] = lo + np.searchsorted(size[lo:hi], size[lo:hi] * 100 // grams.percent, "right")
    order = np.argsort(node, kind="stable")
    cuts = np.searchsorted(node[order], np.arange(len(names) + 1))
    left, right = [], []
    for x in np.argsort(sizes, kind="stable").tolist():
        near = []
        for i in order[cuts[x] : cuts[x + 1]].tolist():
            # block skipping: smaller sets came before (ties: by place in the list), larger ones cannot link
            j = np.arange(low[i], top[i])
            j = j[(size[j] >= size[i]) & (label[node[j]] != label[x]) & (own | (half[node[j]] != half[x]))]
            near.append(node[j[_bound(k[i], pos[i], k[j], pos[j], size[i], size[j]) >= grams.need(size[i], size[j])]])
        other = np.unique(np.concatenate(near))
        other = other[label[other] != label[x]]
        if not len(other):
            continue
        other = other[count[other] > 0]
        common = answers.of(x)[other]
        for y in other[100 * common >= grams.percent * (count[x] + count[other] - common)].tolist():
            if label[y] != label[x]:
                left.append(x)
                right.append(y)
                label[label == label[y]] = label[x]
    a, b = names[np.array(left, np.int64)], names[np.array(right, np.int64)]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def cross_links(entries: DataFrame, sets: DataFrame, grams: Grams) -> DataFrame:
    """Links between different components in open long lists.

    Lists with one smallest node hold much the same sets, so they are dealt together, in blocks of
    nodes, each pair of blocks once, with the sets of its nodes. A pair that shares a short list was
    decided by it.
    """
    centre = entries.groupBy("token").agg(F.min("node").alias("centre"))
    named = entries.join(centre, "token")
    blocks_ = named.groupBy("centre").agg(F.greatest(F.lit(1), F.ceil(F.approx_count_distinct("node") / PAIR_BLOCK)).cast("int").alias("parts"))
    spread = named.join(blocks_, "centre").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = spread.select("centre", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "token", "node", "comp", "size", "pos", "k", side.cast("int").alias("side"))
    dealt = materialize(dealt)
    key = ("centre", "p", "q")
    mine = dealt.select(*(F.col(c).alias(f"s_{c}") for c in key), F.col("node").alias("s_node")).distinct()
    held = mine.join(sets.select(F.col("node").alias("s_node"), "grams"), "s_node")
    return dealt.groupBy(*key).cogroup(held.groupBy(*(f"s_{c}" for c in key))).applyInArrow(lambda x, y: lean(lambda both: _across(*both, grams))((x, y)), "a long, b long")


# ---------------------------------------------------------------- verification


def _places(value: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers of each id."""
    h = mix(value.view(U64) + U64(1))
    return np.stack([(mix(h + U64(k * 0x9E3779B97F4A7C15 % 2**64)) >> U64(64 - bits)).astype(np.int64) for k in range(PROBES)])


def _bloom(ids: DataFrame) -> np.ndarray:
    """Bit array of 2^BLOOM_BITS bits over distinct ids, PROBES of them set for each."""
    bits, chunk = BLOOM_BITS, 1 << 20

    def spread(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(), bits).ravel())
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] // chunk != at[:-1] // chunk, [True]])) if len(at) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([at[a] // chunk], pa.int32()), pa.array([(at[a:b] % chunk).astype("<i4").tobytes()], pa.binary())], ["chunk", "bits"])

    def build(t: pa.Table) -> pa.Table:
        flags = np.zeros(chunk, bool)
        flags[np.frombuffer(b"".join(t.column("bits").to_pylist()), "<i4")] = True
        return pa.table({"chunk": t.column("chunk")[:1], "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    with shuffles_removed(ids.sparkSession):
        found = ids.mapInArrow(lean(spread), "chunk int, bits binary").groupBy("chunk").applyInArrow(lean(build), "chunk int, bits binary").collect()
    out = np.zeros(((1 << bits) // chunk, chunk // 8), np.uint8)
    for r in found:
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _passes(bloom: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the filter lets each id pass: those it was made of, and few others."""
    at = _places(ids, BLOOM_BITS)
    return ((bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(0)


def candidate_sets(docs: DataFrame, wanted: DataFrame, grams: Grams) -> DataFrame:
    """node, grams (5 bytes of each hash, by byte): the sets of the wanted documents (doc_id), and of few others.

    A node may come twice, by a document that the filter lets pass; that repeats a link at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(wanted))

    def run(batches):
        bloom = shared.value
        for batch in batches:
            batch = batch.filter(pa.array(_passes(bloom, batch.column(0).fill_null(-1).to_numpy())))
            for rows, data, offsets in blocks([batch]):
                gram, cuts = grams.sets(data, offsets)
                packed = [gram[cuts[i] : cuts[i + 1]].view(np.uint8).reshape(-1, 8)[:, 3:].T.tobytes() for i in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(gram, cuts, grams.shared), pa.int64()), pa.array(packed, pa.binary())], ["node", "grams"])

    return _texts(docs).mapInArrow(lean(run), "node long, grams binary")


def sets_of(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` (node, grams) of ``nodes`` (node), and of few others, told by a filter: the sets are not moved for it."""
    shared = sets.sparkSession.sparkContext.broadcast(_bloom(nodes))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_passes(shared.value, batch.column(0).to_numpy())))

    return sets.select("node", "grams").mapInArrow(lean(run), "node long, grams binary")


def _keys(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(5, -1).T
    return out.view(np.uint64).ravel()


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of values in both of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def verify(sets: DataFrame, pairs: DataFrame, grams: Grams) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by their whole sets (node, grams)."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep, last, mine = [], None, None
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if a[i] != last:
                    last, mine = a[i], _keys(x)
                other = _keys(y)
                common = _common(mine, other)
                keep.append(100 * common >= grams.percent * (len(mine) + len(other) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    # sets are the large side at every size: one plan, whatever the number of pairs
    with_b = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")
    both = with_b.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a")
    return both.select("a", "b", "ga", "gb").mapInArrow(lean(run), "a long, b long")


# ---------------------------------------------------------------- the operator


def node_components(docs: DataFrame, grams: Grams | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node of each document (doc_id, node, n_shingles), components of nodes (node, comp), and
    verified links between nodes (a, b) that connect each component."""
    grams = grams or Grams()
    nodes = document_nodes(docs, grams)
    buckets = max(1, -(-nodes.count() // BUCKET_DOCS))
    lists = postings(docs, grams, frequent(docs, grams, buckets), buckets)
    near = materialize(lists.groupBy("bucket").applyInArrow(lean(lambda t: _near(t, grams)), _NEAR))
    first = materialize(_first_pairs(near, grams))
    long = materialize(long_entries(near))
    drop_table(near)
    in_long = long.select("node").distinct()
    wanted = first.select(F.col("a").alias("node")).union(first.select(F.col("b").alias("node"))).union(in_long).distinct()
    # one document stands for each node
    holders = nodes.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(-1))).alias("doc_id")).join(wanted, "node")
    sets = materialize(candidate_sets(docs, materialize(holders.select("doc_id").distinct()), grams))
    links = [materialize(verify(sets, first, grams))]
    comp = components(links[0])
    entries = materialize(open_entries(long, comp))
    if entries.isEmpty():
        return nodes, comp, links[0]
    every, sets = sets, materialize(sets_of(sets, entries.select("node").distinct()))
    drop_table(every)
    for turn in range(TURNS):
        pairs = materialize(star_pairs(entries, turn, grams).join(first, ["a", "b"], "left_anti"))
        links.append(materialize(verify(sets, pairs, grams)))
        comp = join_components(comp, links[-1])
        entries = materialize(open_entries(long, comp))
    links.append(materialize(cross_links(entries, sets, grams)))
    return nodes, join_components(comp, links[-1]), reduce(DataFrame.union, links)


def near_duplicates(docs: DataFrame, grams: Grams | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A text without words has an empty set (n_shingles 0) and links with nothing; fewer words than
    an n-gram form one n-gram. component_id is the smallest doc_id reachable by links, itself
    included. Rows that share one id each get the component of their own text, and the id counts in all of
    them; a null id is never the smallest.
    """
    nodes, comp, _ = node_components(docs, grams)
    joined = nodes.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    roots = joined.filter("node <> 0").groupBy("comp").agg(F.min("doc_id").alias("root"))
    named = joined.join(roots, "comp", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("root")).alias("component_id"))


def copies(docs: DataFrame, grams: Grams | None = None) -> DataFrame:
    """key, n, kept of the rows of components of several rows (see ``keep_rows``): one key of each component is kept.

    The winner has the smallest doc_id (null last), then the smallest key. Rows are told apart by
    their key, so an id may be null or stand for several texts.
    """
    key = row_key(docs)
    found = materialize(near_duplicates(docs.select(key.alias("doc_id"), "text"), grams).filter("n_shingles > 0"))
    several = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("component_id")
    grouped = materialize(found.join(several, "component_id").groupBy("component_id", F.col("doc_id").alias("key")).agg(F.count(F.lit(1)).alias("n")))
    ids = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
    named = materialize(grouped.join(ids, "key").distinct())
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("best"))
    return named.join(best, "component_id").select("key", "n", (F.col("key") == F.col("best.key")).alias("kept"))
