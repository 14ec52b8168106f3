"""Helpers shared by the operators: tables, checkpoints, and numpy views of Arrow text.

Conventions of every operator here: a null text counts as empty, a null ``doc_id`` stays
null in the result, columns of the input that an operator does not name are ignored (so
clashing extra columns do no harm), an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from types import GeneratorType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import drop_table, materialize, scratch, shared_folder, shuffles_removed  # noqa: F401

#: Bytes of text handled at once inside a task: the numpy temporaries (8 bytes each) stay in cache.
BLOCK_BYTES = 1 << 18

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(docs: DataFrame) -> Column:
    """64-bit hash of all columns, nulls told apart: the rows of one key are equal, hence interchangeable.

    Two different rows share a key with a probability of about n^2 / 2^65.
    """
    return F.xxhash64(*[docs[c].isNull() for c in docs.columns], *[docs[c] for c in docs.columns])


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """``docs`` with ``__key`` and without the rows whose key is not kept; of equal rows that are kept one stays.

    ``verdict`` (key, n, kept) has one row a key, n counts its rows; keys that it lacks stay. Only
    repeated rows are grouped, so texts with a key of their own are not moved for that.
    """
    keyed = docs.withColumn("__key", row_key(docs))
    named = verdict.select(F.col("key").alias("__key"), "n", "kept")
    found = materialize(named.filter(~F.col("kept") | (F.col("n") > 1)))
    again = materialize(found.filter("kept").select("__key"))
    out = keyed.join(found.select("__key"), "__key", "left_anti")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, "__key", "left_semi").dropDuplicates(["__key"]))
    return out


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold about as much text as is worked on at a time: JVM and worker hold some of each at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for later stages and would hold it until then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of batches or of one group, with ``release`` at its end."""

    def drained(out):
        try:
            yield from out
        finally:
            release()

    def to_the_end(rows):
        out = run(rows)
        if isinstance(out, GeneratorType):
            return drained(out)
        release()
        return out

    return to_the_end


def doc_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def held_out() -> Column:
    return (doc_crc() % 3) == 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over a 64-bit word."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the len+1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


class Hasher:
    """64-bit hashes of byte runs, computed for all runs of a block at once.

    A polynomial over a random byte table: prefix sums give any run's value, a power of the
    inverse base shifts it to a common origin. ``fold`` maps bytes to table rows (lower case).
    """

    def __init__(self, lower: bool = True, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
        if lower:
            self.table[65:91] = self.table[97:123]
        self._powers(1 << 12)

    def _powers(self, n: int) -> None:
        self.up = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_BASE))]))
        self.down = np.cumprod(np.concatenate([[U64(1)], np.full(n, U64(_INV))]))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a block, for several calls of ``runs``."""
        if len(data) >= len(self.up):
            self._powers(max(len(data), 2 * len(self.up)))
        sums = np.empty(len(data) + 1, U64)
        sums[0] = 0
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def edges_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that never cross a row: starts, ends, and the row of each."""
    n = len(mask)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | first[1:n]
    stops = mask.copy()
    stops[:-1] &= ~mask[1:] | first[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(offsets, starts, side="right") - 1


#: Separators of "words between white space": 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True

#: Word bytes of the letter-and-digit words: 0-9, a-z, A-Z (to be lowered), and all of 0x80 up.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

WHITE = b" \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- packed records for shuffles


def squeeze(raw: bytes) -> bytes:
    """zstd with the length in front; what a shuffle carries (its own codec knows no entropy coding)."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def pack(rows: np.ndarray, narrow: dict[str, int] | None = None) -> bytes:
    """A record array, column by column and byte by byte, so that equal bytes lie together.

    ``narrow``: low bytes to keep of a column (little-endian), the rest is dropped.
    """
    planes = []
    for c in rows.dtype.names:
        raw = np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1)
        planes.append(raw[:, : (narrow or {}).get(c, raw.shape[1])].T.tobytes())
    return squeeze(b"".join(planes))


def unpack(blob: bytes, kind: np.dtype, narrow: dict[str, int] | None = None) -> np.ndarray:
    raw = unsqueeze(blob)
    widths = {c: (narrow or {}).get(c, kind[c].itemsize) for c in kind.names}
    n = len(raw) // sum(widths.values())
    rows, at = np.empty(n, kind), 0
    for c, width in widths.items():
        full = np.zeros((n, kind[c].itemsize), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        rows[c] = full.reshape(-1).view(kind[c])
        at += n * width
    return rows
