"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a run of spaces with the word behind it; no piece reaches across units)
are concatenated into one text. A suffix array indexes it, a binary search gives every vocabulary
piece's range of occurrences, each occurrence is an edge from its start to its end, edges are
sorted by end position within their unit, and a relaxation walks the positions: of the edges that
end at a position, the last piece of that prefix's encoding is the one that may stand behind the
last piece at the edge's start. For a BPE model two pieces may stand side by side iff, undoing their
merges from the latest one back, no earlier merge would have joined the boundary; so exactly one
edge survives at each position, and the chain read backwards from the unit's end is the encoding
that the model's merge order gives. Characters outside the vocabulary fall back to byte pieces.

Blank runs are matched like words: their pieces tie on score, and the rule that of equal merges the
left one comes first decides them. The text of a batch is its distinct units, one behind the other; it
is indexed ``INDEX_BYTES`` at a time (the relaxation carries on from slice to slice, also within one
long unit), so memory is bounded and the work linear. Units are dealt with once per worker (a bounded
cache keeps their ids), texts are never cut.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import blocks, lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 400_000
#: Bytes of text in a batch, units that are concatenated, and bytes of them that are indexed together (an edge takes some 30
#: bytes, a byte has some 5 edges).
BATCH_BYTES, JOINED_UNITS, INDEX_BYTES = 1 << 22, 1 << 16, 1 << 19
#: Edges at one position up to which pairs are looked up one by one, and pairs that are remembered for that.
FEW, KNOWN_PAIRS = 24, 1 << 18
NONE = -1


class Vocabulary:
    """Pieces, merge ranks, and the split of each piece, read from a model file.

    ``path``: a SentencePiece BPE model with byte fallback, no normalisation and a dummy prefix.
    """

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unk = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain if len(self.pieces[i]) > 1}, reverse=True))}
        self.rank = np.full(n, -1, np.int64)
        for i in plain:
            if len(self.pieces[i]) > 1:
                self.rank[i] = order[sp.get_score(i)]
        byte_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        raw = [byte_of.get(i) or (b"" if sp.is_control(i) else p.replace(SPACE, " ").encode()) for i, p in enumerate(self.pieces)]
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_start = np.concatenate([[0], np.cumsum(self.raw_len)[:-1]])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        inside = {c for i in plain if len(self.pieces[i]) > 1 for c in self.pieces[i]} - {SPACE}
        joined = {c for c in inside if c in self.ids}
        self.odd = inside - joined  # characters of long pieces that are no pieces themselves
        chars = "".join(re.escape(c) for c in sorted(joined))
        # spaces and the word behind them; spaces before anything else; any other single character
        self.units = re.compile(f"{SPACE}*[{chars}]+|{SPACE}+|[^{SPACE}]" if chars else f"{SPACE}+|[^{SPACE}]", re.DOTALL)
        self._known: dict[tuple[int, int], bool] = {}
        self._merge_tables()

    def merge(self, text: str) -> list[int]:
        """The model's own rule on one unit: join the best-ranked neighbours, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.rank[k] < best):
                    best, at = self.rank[k], i
            if at < 0:
                return self.lookup(parts)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def lookup(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            k = self.ids.get(p)
            out += [k] if k is not None else [self.byte_ids[b] for b in p.encode()]
        return out

    def _merge_tables(self) -> None:
        """left, right: the last merge that builds each piece; pairs: (a, b) -> merged piece."""
        n = len(self.pieces)
        self.left, self.right, reachable, pairs = np.full(n, NONE), np.full(n, NONE), np.zeros(n, bool), {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                reachable[i] = True
                continue
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        for piece, i in sorted(self.ids.items(), key=lambda x: self.rank[x[1]]):
            if len(piece) > 1:
                parts, last = list(piece), None
                while len(parts) > 1:
                    options = [(self.rank[k], j) for j in range(len(parts) - 1) if (k := self.ids.get(parts[j] + parts[j + 1])) is not None]
                    if not options:
                        break
                    _, j = min(options)
                    last = parts[j], parts[j + 1]
                    parts[j : j + 2] = ["".join(last)]
                if len(parts) == 1:
                    reachable[i] = True
                    self.left[i], self.right[i] = (self.ids[x] for x in last)
        used = np.array(sorted(i for i in self.ids.values() if reachable[i]), np.int64)
        self.match_ids = used
        self.match_bytes = [self.pieces[i].encode() for i in used]
        self.match_len = np.array([len(x) for x in self.match_bytes], np.int64)
        keys = np.array([a * n + b for a, b in pairs], np.int64)
        self._size = 1 << 21
        self._key, self._val = np.full(self._size, -1, np.int64), np.zeros(self._size, np.int64)
        self._probes = 1
        for key, c in zip(keys.tolist(), pairs.values()):
            at, k = self._home(np.array([key]))[0], 1
            while self._key[at] >= 0:
                at, k = (at + 1) % self._size, k + 1
            self._key[at], self._val[at] = key, self.rank[c]
            self._probes = max(self._probes, k)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of a and b; a number above all ranks where there is none."""
        key = a * len(self.pieces) + b
        at = self._home(key)
        out = np.full(len(key), 1 << 40, np.int64)
        for k in range(self._probes):
            slot = (at + k) & (self._size - 1)
            hit = self._key[slot] == key
            out[hit] = self._val[slot[hit]]
            if k and not (self._key[slot] >= 0).any():
                break
        return out

    def follows(self, a: int, b: int) -> bool:
        """``may_follow`` of one pair, remembered."""
        found = self._known.get((a, b))
        if found is None:
            if len(self._known) >= KNOWN_PAIRS:
                self._known.clear()
            found = self._known[a, b] = bool(self.may_follow(np.array([a]), np.array([b]))[0])
        return found

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may stand right behind piece a in an encoding."""
        ok = np.ones(len(a), bool)
        live, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), np.full(len(a), 1 << 39, np.int64)
        while len(live):
            bad = self._pair_rank(a, b) < limit
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & (np.maximum(ra, rb) >= 0)
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # the later merge is undone first; of equal ones the right one came later, and a join
            # across the boundary, being further left, would have preceded it
            second = rb >= ra
            limit = np.where(second, rb + 1, ra)
            a, b = np.where(second, a, self.right[a]), np.where(second, self.left[b], b)
        return ok


# ---------------------------------------------------------------- suffix array


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as a big-endian number; ``data`` ends in 8 zero bytes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` (without its last 8 zeros) in order of their first ``depth`` bytes.

    Sorted by 8 bytes, then ties alone by doubled prefixes, whose order is already known.
    """
    n = len(data) - 8
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | data[k : k + n]
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    reach = 8
    while reach < depth:
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[order], rank[n] = group, -1
        tied = ~head
        tied[:-1] |= ~head[1:]
        tied = np.flatnonzero(tied)
        if not len(tied):
            break
        at = order[tied]
        pair = (group[tied].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(at + reach, n)] + 1).astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        order[tied], pair = at[by], pair[by]
        head[tied] = True
        head[tied[1:]] = pair[1:] != pair[:-1]
        reach *= 2
    return order


def occurrences(data: np.ndarray, order: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 rank of the suffixes that begin with each piece: binary search by 8 bytes."""
    keys = _words(data, order)
    low = np.array([int.from_bytes(p[:8].ljust(8, b"\0"), "big") for p in pieces], np.uint64)
    high = np.array([int.from_bytes(p[:8].ljust(8, b"\xff"), "big") for p in pieces], np.uint64)
    lo, hi = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
    for i in [i for i, p in enumerate(pieces) if len(p) > 8 and hi[i] > lo[i]]:
        p, k = pieces[i], 8
        while k < len(p) and hi[i] > lo[i]:
            at = np.minimum(order[lo[i] : hi[i]] + k, len(data) - 8)
            part = _words(data, at)
            a = np.searchsorted(part, np.uint64(int.from_bytes(p[k : k + 8].ljust(8, b"\0"), "big")), "left")
            b = np.searchsorted(part, np.uint64(int.from_bytes(p[k : k + 8].ljust(8, b"\xff"), "big")), "right")
            lo[i], hi[i], k = lo[i] + a, lo[i] + b, k + 8
    return lo, hi


def encode_units(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids of all units, and where each unit's ids start and how many they are.

    Single characters go by a lookup, all others by matching.
    """
    plain = [i for i, u in enumerate(units) if len(u) > 1]
    start, count, flat = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), np.zeros(0, np.int32)
    single = {i: vocab.lookup([u]) for i, u in enumerate(units) if len(u) == 1}
    if plain:
        flat, each, unmatched = _match(vocab, [units[i] for i in plain])
        start[plain], count[plain] = np.cumsum(each) - each, each
        single |= {plain[k]: vocab.merge(units[plain[k]]) for k in unmatched}
    rest = list(single)
    each = np.array([len(single[i]) for i in rest], np.int64)
    start[rest], count[rest] = len(flat) + np.cumsum(each) - each, each
    return np.concatenate([flat, np.array([t for i in rest for t in single[i]], np.int32)]), start, count


def _edges(vocab: Vocabulary, data: np.ndarray, lo: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, end, piece) that start in ``size`` bytes from ``lo``, by suffix array and binary search."""
    part = np.concatenate([data[lo : lo + size + vocab.match_len.max()], np.zeros(8, np.uint8)])
    order = suffix_array(part, int(vocab.match_len.max()))
    low, high = occurrences(part, order, vocab.match_bytes)
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(count), dtype=np.int32), count)
    start = order[np.arange(len(which)) + np.repeat(low - np.cumsum(count) + count, count)]
    mine = start < size
    start, which = start[mine] + lo, which[mine]
    return start, start + vocab.match_len[which], vocab.match_ids[which]


def _match(vocab: Vocabulary, units: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Suffix array, occurrences, edges by position, relaxation: flat ids, ids per unit, and units without a chain."""
    raw = [u.encode() for u in units]
    data = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    size = np.array([len(x) for x in raw], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    of_unit = np.repeat(begin, size + 1)
    last = np.full(len(data) + 1, NONE, np.int32)  # last[e]: the piece that ends before e
    first = np.zeros(len(data), bool)
    first[begin] = True
    for lo in range(0, len(data), INDEX_BYTES):
        start, end, piece = _edges(vocab, data, lo, min(INDEX_BYTES, len(data) - lo))
        place = end - of_unit[start]  # end position within the unit
        by = np.argsort(place.astype(np.uint16) if len(place) and place.max() < 1 << 16 else place, kind="stable")
        start, end, piece, place = start[by], end[by], piece[by], place[by]
        cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(place) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            s, e, t = start[a:b], end[a:b], piece[a:b]
            if b - a < FEW:  # the inside of a long unit
                for s_, e_, t_ in zip(s.tolist(), e.tolist(), t.tolist()):
                    if first[s_] or (last[s_] >= 0 and vocab.follows(int(last[s_]), t_)):
                        last[e_] = t_
                continue
            before = last[s].astype(np.int64)
            good = first[s]
            check = np.flatnonzero(~good & (before >= 0))
            good[check] = vocab.may_follow(before[check], t[check])
            last[e[good]] = t[good]
    length = np.zeros(len(vocab.pieces), np.int64)
    length[vocab.match_ids] = vocab.match_len
    at, live, steps, lost = begin + size, np.arange(len(size)), [], np.zeros(len(size), bool)
    while len(live):
        t = last[at[live]]
        lost[live[t < 0]] = True
        live, t = live[t >= 0], t[t >= 0]
        steps.append((live, t))
        at[live] -= length[t]
        live = live[at[live] > begin[live]]
    owner = np.concatenate([s[0] for s in steps][::-1])
    token = np.concatenate([s[1] for s in steps][::-1])
    by = np.argsort(owner, kind="stable")
    by = by[~lost[owner[by]]]
    return token[by].astype(np.int32), np.bincount(owner[by], minlength=len(size)), np.flatnonzero(lost).tolist()


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class Codec:
    """Encodes and decodes texts; keeps the ids of known units in flat arrays."""

    def __init__(self, path: str = MODEL):
        self.vocab = Vocabulary(path)
        self.reset()

    def reset(self) -> None:
        self.index = _Numbers()
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (int32) of each text; empty for a null or empty one."""
        if len(self.index) > CACHE_UNITS:
            self.reset()
        index, find, rows = self.index, self.vocab.units.findall, []
        known = len(index)
        for text in texts:
            found = find(SPACE + text.replace(" ", SPACE)) if text else []
            rows.append(np.fromiter(map(index.__getitem__, found), np.int64, len(found)))
        fresh = list(islice(index, known, None))
        done = [(self.flat, self.start, self.count)]
        base = len(self.flat)
        for lo in range(0, len(fresh), JOINED_UNITS):
            flat, start, count = encode_units(self.vocab, fresh[lo : lo + JOINED_UNITS])
            done.append((flat, start + base, count))
            base += len(flat)
        if fresh:
            self.flat, self.start, self.count = (np.concatenate([d[k] for d in done]) for k in range(3))
        return [self._expand(self.flat, self.start[r], self.count[r]) for r in rows]

    @staticmethod
    def _expand(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = np.cumsum(count)
        if not len(total):
            return flat[:0]
        return flat[np.repeat(start - total + count, count) + np.arange(total[-1])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, the dummy space dropped, broken bytes as U+FFFD."""
        v = self.vocab
        raw = self._expand(v.raw, v.raw_start[ids], v.raw_len[ids]).tobytes()
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _batched(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    for rows, _, _ in blocks(batches, text, BATCH_BYTES):
        yield rows, rows.column(rows.schema.get_field_index(text)).to_pylist()


def with_ids(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` without its text and with ``ids`` (array of int; null or empty text: no ids).

    Rows keep their order; a column of ``docs`` named ids is replaced.
    """
    kept = [c for c in docs.columns if c not in ("text", "ids")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("ids", ArrayType(IntegerType(), False))])

    def run(batches):
        c = codec(path)
        for rows, texts in _batched(batches, "text"):
            ids = c.encode(texts)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32))
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(kept))), pa.ListArray.from_arrays(offsets, values)], [*kept, "ids"])

    return docs.select(*kept, "text").mapInArrow(lean(run), schema)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    return with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of every array of ids (null: empty)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_crc32 (of the ids as little-endian int32),
    decoded_sha256 (of the text decoded from the ids) and round_trip (whether it is the original).

    A text that holds U+2581 itself decodes to spaces there, so it does not round-trip.
    """

    def run(batches):
        c = codec(path)
        for rows, texts in _batched(batches, "text"):
            ids = c.encode(texts)
            back = [c.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<i4").tobytes()) for x in ids], pa.int64()),
                pa.array([sha256(b.encode()).hexdigest() for b in back]), pa.array([b == (t or "") for b, t in zip(back, texts)], pa.bool_()),
            ], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
