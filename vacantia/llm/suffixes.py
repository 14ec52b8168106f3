"""Suffix-array dedup of exact passages by difference-cover blockwise sorting.

A byte is removed when a string of ``length`` bytes that covers it also starts in a document with a
smaller id. Only the order of suffixes to that depth matters, so the suffixes are sorted block by
block, and blocks are made so that equal strings meet:

1. Blocks. A window of ``length`` bytes is assigned to its minimizer, the leftmost of its k-grams
   with the least hash. Equal windows have equal minimizers, and a minimizer met in one document only
   cannot hold a repeat: fingerprints of the minimizers are counted over the whole table first, and
   only the windows of the others are sorted.
2. Pieces. The windows of one minimizer occurrence are consecutive, so they travel as short pieces of
   text. Equal pieces are folded before the shuffle: the smallest document keeps the piece, the rest
   lose all its windows. Minimizers with so many occurrences that one task could not hold them are cut
   into single windows, which are dealt by their own hash; equal windows fold, so no group is unbounded.
3. Blockwise sort. A task takes ``SORT_BYTES`` of pieces at a time and first ranks the difference-cover
   sample of that text. Its suffixes are then sorted one suffix bucket (equal leading bytes) at a time by
   their first ``COVER`` bytes, and ties are resolved by the ranks at hand: for any two suffixes some
   shift below ``COVER`` brings both onto sample positions, whose ranks compare the next
   ``length - COVER + 1`` bytes in one step; the last ``COVER - 1`` bytes are compared as numbers.

Rows are told apart by id and, where an id is null or occurs twice, a hash of the text. Spans are
merged per row and cut from its text. The text is shuffled by id once.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Hasher, blocks, materialize, mix, pack, squeeze, unpack, unsqueeze

LENGTH = 50
GRAM = 20
#: Period and residues of the difference cover: every residue mod 13 is a difference of two of these.
COVER, RESIDUES = 13, (0, 1, 3, 9)
#: Bytes of text for each shuffle bucket.
BUCKET_BYTES = 16 << 20
#: Minimizers, or pieces, that a map task gathers before it deals them out.
FLUSH, FLUSH_PIECES = 1 << 19, 1 << 17
#: Bytes of pieces sorted at a time, and windows in a suffix bucket unless they share more leading bytes than a bucket tells.
SORT_BYTES, SUFFIX_BUCKET = 1 << 21, 1 << 17
#: Occurrences from which a minimizer is cut into windows (a millionth of all minimizers where that is more).
HOT, HOT_SHARE = 1 << 15, 20
#: Bytes of one text whose windows are taken at a time, and flags of one text that become pieces at a time.
CHUNK, FLAGS = 1 << 22, 1 << 15
_PLACE = 28  # bits of a position within a block; hashes are compared by the others

#: A minimizer's run of windows: its row (doc, tie), first window, further windows, place in the first window, number of
#: such runs that it stands for, whether they lie in several documents, hash.
_MARKS = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<i4"), ("more", "u1"), ("inner", "u1"), ("n", "<u4"), ("many", "u1"), ("hash", "<u8")])
#: Of a hash the marks carry what the bucket does not tell: more than 40 bits would tell nothing new.
_NARROW = {"hash": 5}
_LOW = U64((1 << 40) - 1)
_HEAD = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<i4"), ("more", "u1"), ("hash", "<u8")])
_FLAG = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("at", "<i4"), ("more", "u1"), ("inner", "u1")])
_RUN = np.dtype([("doc", "<i8"), ("tie", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _scramble(x: np.ndarray) -> np.ndarray:
    """A quick finalizer for polynomial hashes, in place."""
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _span(length: int) -> int:
    """k-grams in a window; a minimizer's run has this many windows at most, so it must fit a byte."""
    if not GRAM <= length < GRAM + 255:
        raise ValueError("the length must be from 20 to 274 bytes")
    return length - GRAM + 1


def _width(length: int) -> int:
    """Bytes of the widest piece, in whole words."""
    return -(-(length + _span(length) - 1) // 8) * 8


def minimizers(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: row, hash, first window, further windows, and place in the first window of each run of windows with one minimizer."""
    n, span = len(data), _span(length)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(U64), none, none, none
    sums = hasher.sums(data)
    value = sums[GRAM:] - sums[: n - GRAM + 1]
    value *= hasher.down[: n - GRAM + 1]
    _scramble(value)
    least = value & ~U64((1 << _PLACE) - 1)
    least |= np.arange(len(value), dtype=U64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    new = np.ones(len(least), bool)
    np.not_equal(least[1:], least[:-1], out=new[1:])
    whole = np.ones(len(least), bool)  # windows within a row
    for o in offsets[1:-1]:
        whole[max(0, o - length + 1) : o] = False
    new[offsets[1:-1][offsets[1:-1] < len(new)]] = True
    new &= whole
    stop = np.ones(len(least), bool)
    np.logical_or(new[1:], ~whole[1:], out=stop[:-1])
    first, last = np.flatnonzero(new), np.flatnonzero(stop & whole)
    place = (least[first] & U64((1 << _PLACE) - 1)).astype(np.int64)
    return np.searchsorted(offsets, first, "right") - 1, value[place], first, last - first, place - first


def chunked_minimizers(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, length: int):
    """``minimizers`` of a block; a long text (a block of one row) is taken ``CHUNK`` windows at a time, so memory does not follow it."""
    if len(offsets) > 2 or len(data) <= CHUNK:
        yield minimizers(data, offsets, hasher, length)
        return
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK + length - 1]
        row, value, first, more, inner = minimizers(part, np.array([0, len(part)]), hasher, length)
        yield row, value, first + lo, more, inner


def _deal(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> U64(40)) % U64(buckets)).astype(np.int64)


def _cuts(*sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of each run of equal values."""
    if not len(sorted_[0]):
        return []
    new = np.zeros(len(sorted_[0]) - 1, bool)
    for x in sorted_:
        new |= x[1:] != x[:-1]
    edge = [0, *(np.flatnonzero(new) + 1).tolist(), len(sorted_[0])]
    return list(zip(edge[:-1], edge[1:]))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, doc (the id; a null one counts as the greatest long), tie (0 where doc occurs once, else a hash of the text), text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    shared = materialize(base.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", F.lit(True).alias("shared")))
    if shared.isEmpty():
        return base.withColumn("tie", F.lit(0).cast("long"))
    return base.join(shared, "doc", "left").withColumn("tie", F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")).drop("shared")


def _repeats(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which marks have a hash that occurs in two documents or more, one mark of each such hash, and its sum of n."""
    order = np.argsort(rows["hash"])
    start = np.array([a for a, _ in _cuts(rows["hash"][order])], np.int64)
    doc = rows["doc"][order]
    twice = (np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)) | np.maximum.reduceat(rows["many"][order], start).astype(bool)
    out = np.zeros(len(rows), bool)
    out[order] = np.repeat(twice, np.diff(np.append(start, len(rows))))
    return out, order[start[twice]], np.add.reduceat(rows["n"][order].astype(np.int64), start)[twice]


def _marks(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """bucket, marks: the minimizers of all texts. Negative buckets: flags (by block) of those known to repeat within the task."""

    def run(batches):
        hasher, held, size = Hasher(lower=False), [], 0

        def flush():
            rows = np.concatenate(held)
            twice, one, n = _repeats(rows)
            # of a hash met in several documents here one mark goes on, so a frequent one is a mark a flush
            sent = ~twice
            sent[one] = True
            rows["n"][one], rows["many"][one] = np.minimum(n, (1 << 32) - 1), 1
            dealt = rows[sent]
            bucket = _deal(dealt["hash"], buckets)
            by = np.argsort(bucket, kind="stable")
            bucket, dealt = bucket[by], dealt[by]
            out = [(int(bucket[a]), None, pack(dealt[a:b], _NARROW)) for a, b in _cuts(bucket)]
            out += [(-1 - k, k, blob) for k, blob in _by_block(_as(_FLAG, rows[twice]), buckets)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["bucket", "block", "marks"])

        for rows, data, offsets in blocks(batches):
            doc, tie = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            for row, value, first, more, inner in chunked_minimizers(data, offsets, hasher, length):
                part = np.empty(len(row), _MARKS)
                part["doc"], part["tie"], part["at"], part["hash"], part["more"], part["inner"], part["n"], part["many"] = doc[row], tie[row], first - offsets[row], value, more, inner, 1, 0
                held.append(part)
                size += len(part)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("doc", "tie", "text").mapInArrow(run, "bucket long, block long, marks binary")


def _as(kind: np.dtype, rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), kind)
    for c in kind.names:
        out[c] = rows[c]
    return out


def _by_block(rows: np.ndarray, n: int) -> list[tuple[int, bytes]]:
    """Records dealt to blocks of rows: a packed row for each block that has some."""
    block = (mix(rows["doc"].astype(U64) ^ mix(rows["tie"].astype(U64))) % U64(n)).astype(np.int64)
    by = np.lexsort((rows["tie"], rows["doc"], block))
    rows, block = rows[by], block[by]
    return [(int(block[a]), pack(rows[a:b])) for a, b in _cuts(block)]


def _blocks_table(rows: np.ndarray, n: int) -> pa.Table:
    dealt = _by_block(rows, n)
    return pa.table({"block": pa.array([k for k, _ in dealt], pa.int64()), "rows": pa.array([x for _, x in dealt], pa.binary())})


def _by_document(blocks_: DataFrame, kind: np.dtype, name: str) -> DataFrame:
    """doc, tie and the packed records of each row, from packed rows of blocks (block, rows)."""

    def gather(group: pa.Table) -> pa.Table:
        rows = np.concatenate([unpack(x, kind) for x in group.column("rows").to_pylist()])
        rows = rows[np.lexsort((rows["tie"], rows["doc"]))]
        cuts = _cuts(rows["doc"], rows["tie"])
        first = [a for a, _ in cuts]
        return pa.table({"doc": pa.array(rows["doc"][first]), "tie": pa.array(rows["tie"][first]), name: pa.array([rows[a:b].tobytes() for a, b in cuts], pa.binary())})

    return blocks_.groupBy("block").applyInArrow(gather, f"doc long, tie long, {name} binary")


#: Block of the rows that name hot minimizers instead of flags.
_HOT_BLOCK = -1


def _shared_marks(group: pa.Table, buckets: int, hot: int) -> pa.Table:
    """Flags of repeating minimizers, by block of rows; and the hashes of those with ``hot`` occurrences or more."""
    if group.column("bucket")[0].as_py() < 0:
        return group.select(["block", "marks"]).rename_columns(["block", "rows"])
    rows = np.concatenate([unpack(x, _MARKS, _NARROW) for x in group.column("marks").to_pylist()])
    twice, one, n = _repeats(rows)
    many = np.sort(rows["hash"][one[n >= hot]] | U64(group.column("bucket")[0].as_py()) << U64(40))
    out = _blocks_table(_as(_FLAG, rows[twice & (rows["many"] == 0)]), buckets)  # the others have their flags
    return pa.concat_tables([out, pa.table({"block": pa.array([_HOT_BLOCK], pa.int64()), "rows": pa.array([many.tobytes()], pa.binary())})]) if len(many) else out


def _runs(head: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(head), _RUN)
    out["doc"], out["tie"], out["start"], out["end"] = head["doc"], head["tie"], start, end
    return out


# ---------------------------------------------------------------- pieces


def _hash_at(hasher: Hasher, data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    value = np.zeros(len(at), U64)
    for k in range(size):
        value += hasher.table[data[at + k]] * hasher.up[k]
    return _scramble(value)


def _pieces(marked: DataFrame, buckets: int, length: int, hot: np.ndarray) -> DataFrame:
    """bucket, head and body (packed pieces); negative buckets: spans (head, by block) decided within the task.

    ``marked``: doc, tie, text, flags (packed runs of windows whose minimizer repeats). Runs of the
    minimizers in ``hot`` (sorted) become pieces of one window each.
    """
    width = _width(length)

    def run(batches):
        hasher = Hasher(lower=False)
        held, size = [], 0

        def flush():
            head, body = (np.concatenate([h[i] for h in held]) for i in range(2))
            top = _same_pieces(head, body)
            gone = head["doc"] > head["doc"][top]
            keep = np.flatnonzero(~gone)
            bucket = _deal(head["hash"][keep], buckets)
            by = np.argsort(bucket, kind="stable")
            bucket, by = bucket[by], keep[by]
            out = [(int(bucket[a]), pack(head[by[a:b]]), squeeze(body[by[a:b]].tobytes()), None) for a, b in _cuts(bucket)]
            lost = head[gone]
            out += [(-1 - k, blob, None, k) for k, blob in _by_block(_runs(lost, lost["at"], lost["at"] + lost["more"] + length), buckets)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["bucket", "head", "body", "block"])

        def cut(data, offsets, who, flag, row):
            start = flag["at"] + offsets[row]
            fits = start + flag["more"] + length <= offsets[row + 1]
            flag, row, start = flag[fits], row[fits], start[fits]
            value, more = _hash_at(hasher, data, start + flag["inner"], GRAM), flag["more"].astype(np.int64)
            if len(hot):
                many = np.isin(_deal(value, buckets).astype(U64) << U64(40) | value & _LOW, hot)
                windows = np.where(many, more + 1, 1)
                inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
                row, start, value, more, many = (np.repeat(x, windows) for x in (row, start, value, np.where(many, 0, more), many))
                start = start + inner
                value[many] = _hash_at(hasher, data, start[many], length)
            body = np.lib.stride_tricks.sliding_window_view(data, width)[start]
            body[np.arange(width) >= (more + length)[:, None]] = 0
            head = np.empty(len(start), _HEAD)
            head["doc"], head["tie"], head["at"], head["more"], head["hash"] = who[0][row], who[1][row], start - offsets[row], more, value
            return head, body

        for rows, data, offsets in blocks(batches):
            packed = [x or b"" for x in rows.column(3).to_pylist()]
            flags = np.frombuffer(b"".join(packed), _FLAG)
            row = np.repeat(np.arange(rows.num_rows), [len(x) // _FLAG.itemsize for x in packed])
            who = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            padded = np.concatenate([data, np.zeros(width, np.uint8)])
            for lo in range(0, len(flags), FLAGS):
                held.append(cut(padded, offsets, who, flags[lo : lo + FLAGS], row[lo : lo + FLAGS]))
                size += len(held[-1][0])
                if size >= FLUSH_PIECES:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    # doc_id comes along so that both joins with the texts can use one exchange of them
    return marked.select("doc", "tie", "text", "flags", "doc_id").mapInArrow(run, "bucket long, head binary, body binary, block long")


def _same_pieces(head: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each piece the entry of the smallest document with the same piece (equal bytes and length)."""
    words = body.view("<u8")
    key = head["hash"] ^ head["more"].astype(U64)
    for k in range(words.shape[1]):
        key = mix(key ^ words[:, k])
    order = np.lexsort((head["doc"], key))
    same = np.zeros(len(order), bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    follows = np.flatnonzero(same)
    a, b = order[follows - 1], order[follows]
    same[follows] = (words[a] == words[b]).all(1) & (head["more"][a] == head["more"][b])
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
    return out


# ---------------------------------------------------------------- blockwise sort


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of numbers."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _words(text: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """``size`` bytes from each position as big-endian numbers of up to 8 bytes."""
    out = []
    for lo in range(0, size, 8):
        w = np.zeros(len(at), U64)
        for k in range(lo, min(lo + 8, size)):
            w = (w << U64(8)) | text[at + k]
        out.append(w)
    return out


#: For each residue a and sample residue d: the shift that brings a position a onto the sample.
_SHIFTS = np.array([[(d - a) % COVER for d in RESIDUES] for a in range(COVER)])


class CoverRanks:
    """Ranks of the difference-cover sample of a text, to the depth that all shifts of a window allow."""

    def __init__(self, text: np.ndarray, length: int):
        depth = length - COVER + 1
        n = max(0, len(text) - depth + 1)
        periods = -(-n // COVER)
        place = (np.arange(periods)[:, None] * COVER + np.array(RESIDUES)).ravel()
        self.rank = np.zeros(len(place), np.int32)
        inside = place < n
        self.rank[inside] = _ranks(*_words(text, place[inside], depth))

    def at(self, places: np.ndarray) -> np.ndarray:
        """Ranks of sample positions."""
        return self.rank[places // COVER * len(RESIDUES) + _NUMBER[places % COVER]]


_NUMBER = np.full(COVER, -1)
_NUMBER[list(RESIDUES)] = range(len(RESIDUES))


def suffix_buckets(text: np.ndarray, window: np.ndarray, most: int) -> list[np.ndarray]:
    """Numbers of windows, dealt to suffix buckets in the order of their leading two bytes: windows with
    equal ones share a bucket, and consecutive small ones are joined up to ``most`` windows."""
    lead = text[window].astype(np.int64) << 8 | text[window + 1]
    order = np.argsort(lead, kind="stable")
    edge = np.append(np.cumsum(np.bincount(lead, minlength=1 << 16)), len(window))
    out, lo = [], 0
    while lo < len(order):
        k = int(np.searchsorted(edge, lo + most, "right"))
        hi = int(edge[k - 1]) if k and edge[k - 1] > lo else int(edge[np.searchsorted(edge, lo, "right")])
        out.append(order[lo:hi])
        lo = hi
    return out


def least_documents(text: np.ndarray, window: np.ndarray, doc: np.ndarray, group: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """For each window of ``length`` bytes the smallest document with an equal one (in its ``group``, where that is given).

    ``text`` has ``length`` bytes behind every window start. The cover sample is ranked first; then
    suffix buckets are sorted one at a time, by the windows' first and last COVER bytes, and ties that
    lie in several documents are split by the ranks.
    """
    out, ranks = doc.copy(), CoverRanks(text, length)
    for bucket in suffix_buckets(text, window, SUFFIX_BUCKET):
        out[bucket] = _bucket_least(text, window[bucket], doc[bucket], () if group is None else (group[bucket],), ranks, length)
    return out


def _bucket_least(text: np.ndarray, window: np.ndarray, doc: np.ndarray, keys: tuple, ranks: CoverRanks, length: int) -> np.ndarray:
    out = doc.copy()
    group = _ranks(*keys, *_words(text, window, COVER), *_words(text, window + length - COVER + 1, COVER - 1))
    lo, hi = np.full(group.max() + 1, np.iinfo(np.int64).max), np.full(group.max() + 1, np.iinfo(np.int64).min)
    np.minimum.at(lo, group, doc)
    np.maximum.at(hi, group, doc)
    tied = np.flatnonzero((lo != hi)[group])
    if not len(tied):
        return out
    at, group = window[tied], group[tied]
    shift = _SHIFTS[at % COVER]
    g = np.repeat(group, len(RESIDUES))
    key = _ranks(g * COVER + shift.ravel(), ranks.at((at[:, None] + shift).ravel()))
    who = np.repeat(doc[tied], len(RESIDUES))
    least = np.full(key.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, key, who)
    out[tied] = least[key].reshape(-1, len(RESIDUES)).min(1)
    return out


def _sorted_blocks(group: pa.Table, length: int, buckets: int) -> pa.Table:
    """Removed spans of one shuffle bucket, a bounded run of its minimizers at a time."""
    if group.column("bucket")[0].as_py() < 0:
        return group.select(["block", "head"]).rename_columns(["block", "rows"])
    head = np.concatenate([unpack(x, _HEAD) for x in group.column("head").to_pylist()])
    body = np.frombuffer(b"".join(map(unsqueeze, group.column("body").to_pylist())), np.uint8).reshape(len(head), -1)
    order = np.argsort(head["hash"], kind="stable")
    edge = np.array([0, *(b for _, b in _cuts(head["hash"][order]))])
    found, a = [], 0
    while a + 1 < len(edge):
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + SORT_BYTES // body.shape[1], "right")) - 1)
        mine = order[edge[a] : edge[b]]
        found += _block(head[mine], body[mine], length)
        a = b
    return _blocks_table(np.concatenate(found), buckets)


def _block(head: np.ndarray, body: np.ndarray, length: int) -> list[np.ndarray]:
    """Removed spans of the pieces of whole minimizers."""
    doc, at = head["doc"], head["at"].astype(np.int64)
    top = _same_pieces(head, body)
    gone = doc > doc[top]
    out = [_runs(head[gone], at[gone], at[gone] + head["more"][gone] + length)]
    # distinct pieces of minimizers that hold several: their windows are sorted
    piece = np.flatnonzero(top == np.arange(len(top)))
    piece = piece[np.argsort(head["hash"][piece], kind="stable")]
    hashes = head["hash"][piece]
    several = np.zeros(len(piece), bool)
    several[1:] = hashes[1:] == hashes[:-1]
    several[:-1] |= several[1:]
    piece = piece[several]
    if not len(piece):
        return out
    windows = head["more"][piece].astype(np.int64) + 1
    text = np.concatenate([body[piece].ravel(), np.zeros(length, np.uint8)])
    owner = np.repeat(np.arange(len(piece)), windows)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    mine = doc[piece][owner]
    lost = least_documents(text, owner * body.shape[1] + inner, mine, length=length) < mine
    owner, inner = owner[lost], inner[lost]
    if not len(owner):
        return out
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (inner[1:] != inner[:-1] + 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(owner)) - 1
    run_owner, run_lo, run_hi = owner[lo], inner[lo], inner[hi] + length
    # every occurrence of a piece in its smallest document loses these runs
    number = np.full(len(top), -1)
    number[piece] = np.arange(len(piece))
    stays = np.flatnonzero(~gone)
    holder = number[top[stays]]
    stays, holder = stays[holder >= 0], holder[holder >= 0]
    left = np.searchsorted(run_owner, holder, "left")
    count = np.searchsorted(run_owner, holder, "right") - left
    who = np.repeat(stays, count)
    which = np.repeat(left - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    out.append(_runs(head[who], at[who] + run_lo[which], at[who] + run_hi[which]))
    return out


# ---------------------------------------------------------------- the operator


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of spans that may overlap or touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    lo = np.flatnonzero(new)
    return s[lo], e[np.append(lo[1:], len(s)) - 1]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, text and the removed spans (packed runs) of every row."""
    base = _texts(docs)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    hot = max(HOT, 2 * size // (_span(length) + 1) >> HOT_SHARE)
    marks = _marks(base, buckets, length)
    # what tasks have decided goes through the same shuffle, so that texts are read for marks, and for pieces, once
    shared = materialize(marks.groupBy("bucket").applyInArrow(lambda t: _shared_marks(t, buckets, hot), "block long, rows binary"))
    # at most 2^HOT_SHARE hashes of 8 bytes: each stands for that part of all minimizers or more
    many = np.sort(np.frombuffer(b"".join(bytes(r.rows) for r in shared.filter(F.col("block") == _HOT_BLOCK).select("rows").collect()), U64))
    flags = _by_document(shared.filter(F.col("block") != _HOT_BLOCK), _FLAG, "flags")
    dealt = _pieces(base.join(flags, ["doc", "tie"]), buckets, length, many)
    spans = _by_document(dealt.groupBy("bucket").applyInArrow(lambda t: _sorted_blocks(t, length, buckets), "block long, rows binary"), _RUN, "spans")
    return base.join(spans, ["doc", "tie"], "left").select("doc_id", "text", "spans")


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Texts shorter than ``length`` lose nothing, a null text is empty. Strings within one document, or
    in rows that share an id, are no repeats of each other; a null id counts as the greatest long, so
    such rows lose what any other document has and take nothing from each other.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                run_ = np.frombuffer(spans or b"", _RUN)
                s, e = merge_spans(run_["start"], np.minimum(run_["end"], len(raw)))
                at, kept = 0, []
                for a, b in zip(s.tolist(), e.tolist()):
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(s), sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return repeated_spans(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
