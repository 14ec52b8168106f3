"""Exact dedup against a minimal perfect hash of historical digests.

Texts are equal when identical after deleting white space (0x20, 0x09-0x0D); SHA-256 of that
normal form stands for the text. The historical distinct digests are dealt to buckets, and each
bucket gets a minimal perfect hash (pilots for small groups of keys): n digests fill exactly n
slots, a slot holds the full digest and the winner's locator. An arrival finds its slot in
constant time and compares all 32 bytes: equal means a repeat of history, anything else is a
nonmember, and nonmembers are grouped among themselves.

Shuffles carry digests only, never texts. Rows are aggregated by digest before each shuffle, so
a group with a third of all rows is one row per map task; the one join back to the rows is a
plain equi-join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, doc_crc, lean, materialize, row_key

#: Distinct digests that a bucket holds on average; the number of buckets follows the table.
BUCKET_KEYS = 4096
KEYS_PER_PILOT = 4
_DIGEST = np.dtype([("group", "<u8"), ("slot", "<u8"), ("rest", "V16")])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, digests = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            chars.append(len(text))
            digests.append(hashlib.sha256(text.encode().translate(None, WHITE)).digest())
        rest = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(digests, pa.binary()), *batch.columns[2:]], ["doc_id", "chars", "digest", *rest])


def digests(docs: DataFrame, with_key: bool = False) -> DataFrame:
    """doc_id, chars (code points of the original text), digest (of the normal form), and if wanted key (of the row)."""
    key = [row_key(docs).alias("key")] if with_key else []
    schema = "doc_id long, chars long, digest binary" + ", key long" * with_key
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *key).mapInArrow(lean(_digests), schema)


def winners(keyed: DataFrame) -> DataFrame:
    """One row per digest: chars and doc_id of the row that stays, and the number of rows."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("neg_id"))).alias("best")
    grouped = keyed.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    return grouped.select("digest", F.col("best.chars").alias("chars"), F.col("best.neg_id").alias("neg_id"), "n")


# ---------------------------------------------------------------- minimal perfect hash


def _slot(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    """Slot of each key under its group's pilot; a negative pilot names the slot itself."""
    x = (h ^ (pilot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return np.where(pilot < 0, -pilot - 1, (x % np.uint64(n)).astype(np.int64))


def build_mph(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys: n distinct 32-byte digests as ``_DIGEST``. Gives pilots, and the slot of each key."""
    n = len(keys)
    groups = max(1, -(-n // KEYS_PER_PILOT))
    group = (keys["group"] % np.uint64(groups)).astype(np.int64)
    pilots, slots, taken = np.zeros(groups, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(groups + 1))
    sizes = np.diff(cuts)
    for g in np.argsort(-sizes, kind="stable"):
        members = order[cuts[g] : cuts[g + 1]]
        if len(members) < 2:
            break
        h, tried = keys["slot"][members], np.arange(64, dtype=np.int64)
        while True:
            at = _slot(h[None, :], tried[:, None], n)
            free = ~taken[at].any(1)
            spread = np.sort(at, 1)
            free &= (spread[:, 1:] != spread[:, :-1]).all(1)
            if free.any():
                k = int(np.argmax(free))
                pilots[g], slots[members] = tried[k], at[k]
                taken[at[k]] = True
                break
            tried = tried + 64
    single = np.flatnonzero(sizes == 1)
    left = np.flatnonzero(~taken)[: len(single)]
    pilots[single], slots[order[cuts[single]]] = -left - 1, left
    return pilots, slots


def lookup_mph(pilots: np.ndarray, slot_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Slot of each key, or -1: the slot's stored digest is compared byte for byte."""
    n = len(slot_keys)
    if not n or not len(keys):
        return np.full(len(keys), -1, np.int64)
    group = (keys["group"] % np.uint64(len(pilots))).astype(np.int64)
    at = _slot(keys["slot"], pilots[group], n)
    a, b = (x.view(np.uint8).reshape(-1, 32) for x in (np.ascontiguousarray(slot_keys[at]), np.ascontiguousarray(keys)))
    return np.where((a == b).all(1), at, -1)


def _as_keys(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _DIGEST)


def _build(group: pa.Table) -> pa.Table:
    pilots, slots = build_mph(_as_keys(group.column("digest")))
    by_slot = group.take(pa.array(np.argsort(slots)))
    return pa.table({
        "bucket": [group.column("bucket")[0].as_py()], "pilots": pa.array([pilots.tolist()], pa.list_(pa.int64())),
        "digests": pa.array([b"".join(by_slot.column("digest").to_pylist())], pa.binary()),
        **{c: pa.array([by_slot.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("chars", "neg_id", "n")},
    })


INDEX_SCHEMA = "bucket long, pilots array<long>, digests binary, chars array<long>, neg_id array<long>, n array<long>"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def buckets_for(rows: int) -> int:
    return max(1, -(-rows // BUCKET_KEYS))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """The lookup table of ``winners`` rows: one row per bucket, arrays in slot order."""
    return history.select(_bucket(buckets), "*").groupBy("bucket").applyInArrow(lean(_build), INDEX_SCHEMA)


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of longs (null: the least long) and which of them are there."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _probe(index: pa.Table, arrivals: pa.Table) -> pa.Table:
    columns, none = ("chars", "neg_id", "n"), np.zeros(0, np.int64)
    slot_keys, pilots, held = np.zeros(0, _DIGEST), none, {c: (none, none.astype(bool)) for c in columns}
    keys, mine = slot_keys, dict(held)
    if index.num_rows:
        slot_keys = np.frombuffer(index.column("digests")[0].as_py(), _DIGEST)
        pilots = index.column("pilots")[0].values.to_numpy()
        held = {c: _numbers(index.column(c)[0].values) for c in columns}
    if arrivals.num_rows:
        keys = _as_keys(arrivals.column("digest"))
        mine = {c: _numbers(arrivals.column(c)) for c in columns}
    at = lookup_mph(pilots, slot_keys, keys)
    known, fresh = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    slot = at[known]
    held = {c: (v.copy(), ok.copy()) for c, (v, ok) in held.items()}
    # more code points win, then any id over none, then the greater complement, which is the smaller id
    new, old = ([x["neg_id"][0][i], x["neg_id"][1][i], x["chars"][0][i]] for x, i in ((mine, known), (held, slot)))
    wins = np.zeros(len(known), bool)
    for a, b in zip(new, old):  # the last one decides first
        wins = (a > b) | ((a == b) & wins)
    held["n"][0][slot] += mine["n"][0][known]
    for c in ("chars", "neg_id"):
        for k in range(2):
            held[c][k][slot[wins]] = mine[c][k][known[wins]]
    digest = np.concatenate([slot_keys.view("V32").ravel(), keys[fresh].view("V32").ravel()])
    return pa.table({
        "digest": pa.array([x.tobytes() for x in digest], pa.binary()),
        **{c: pa.array(np.concatenate([held[c][0], mine[c][0][fresh]]), mask=~np.concatenate([held[c][1], mine[c][1][fresh]])) for c in columns},
    })


def groups(history: DataFrame, arrivals: DataFrame, buckets: int) -> DataFrame:
    """One row per distinct digest of both sides (``digests`` rows): digest, keep_id, group_size.

    Arrivals that the index knows join the historical group (and win it with more code points,
    then the smaller id); nonmembers form groups of their own.
    """
    index = build_index(winners(history), buckets)
    coming = winners(arrivals).select(_bucket(buckets), "*")
    merged = index.groupBy("bucket").cogroup(coming.groupBy("bucket")).applyInArrow(lambda x, y: lean(lambda both: _probe(*both))((x, y)), "digest binary, chars long, neg_id long, n long")
    return merged.select("digest", F.bitwise_not("neg_id").alias("keep_id"), F.col("n").alias("group_size"))


def dedup(docs: DataFrame, is_history=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``is_history``: Column that marks the rows already ingested (default: an even crc32 of the
    id). The split decides which side a row comes from, never the result. Rows that share one
    id and one text are copies of each other and all carry that id as keep_id; rows with a null
    id lose every tie. Rows with one id and different texts are in the groups of their own texts, so
    kept (doc_id = keep_id) may hold for several rows of a group. Every row is counted and joined by its
    digest; where one text holds much of the table (all null texts share one digest), adaptive execution
    splits that key's rows, as the other side has one row a digest.
    """
    keyed = materialize(digests(docs))
    old = (doc_crc() % 2 == 0) if is_history is None else is_history
    found = groups(keyed.filter(old), keyed.filter(~old), buckets_for(keyed.count()))
    joined = keyed.join(found, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def copies(docs: DataFrame) -> DataFrame:
    """key, n, kept of the rows that share their text with another (see ``keep_rows``): one key of each group is kept.

    The winner is that of ``dedup``; where rows share its id, the one with the most code points, then the greatest key.
    """
    keyed = materialize(digests(docs, with_key=True))
    old = doc_crc() % 2 == 0
    found = groups(keyed.filter(old), keyed.filter(~old), buckets_for(keyed.count())).filter("group_size > 1")
    shared = materialize(keyed.join(found, "digest").withColumn("may_win", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("digest", "chars", "key", "may_win"))
    mine = shared.filter("may_win").groupBy("digest", "key").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    best = mine.groupBy("digest").agg(F.max(F.struct("chars", "key")).alias("best"))
    won = mine.join(best, "digest").select("key", "n", (F.col("key") == F.col("best.key")).alias("kept"))
    lost = shared.filter("not may_win").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.lit(False))
    return won.union(lost)
