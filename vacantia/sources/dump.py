"""SQL dumps as a data source: INSERT statements of any length, read by byte ranges, typed from their literals.

``read_dump`` goes over the files twice. Whether a byte stands in a text, how deep in parentheses, and under
which column list depends on all bytes before it, so the first pass gives, for each range, what it does
to that state from either beginning (inside a text or not); those rows, one a range, are put together in
order. The second pass reads each range from its known state. A tuple belongs to the range in which it
opens, and its reader goes on past the range to its end.

Texts are quoted by ' and doubled inside; identifiers hold no quotes or parentheses; comments no single '.
Values as in the statements: bare numbers, true and false, null, texts, and other bare words as text. A column's
type is the widest of its first INFER_ROWS values (text, if these are all null). A tuple with another number
of values, or a value that its column's type cannot hold, is a row of ``errors`` instead.

``spark.read.format("sql_dump").load(path)`` without the first pass reads one file in one task. Paths are folders or
files, on any file system that Arrow opens.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..tables import scratch

RANGE_BYTES, INFER_ROWS, BATCH_ROWS = 1 << 25, 1000, 4096
#: Bytes read beyond a range for a column list or tuple that it begins (doubled until its end is there), and before it.
BEYOND, BEHIND = 1 << 16, 1 << 12
ERRORS = "file string, at long, n int, tuple string"
_HEADER = re.compile(rb"\bINSERT\s+INTO\s+([^\s(]+)\s*\(([^()]*)\)\s*VALUES\b", re.IGNORECASE)
_TOKEN = re.compile(r"'[^']*(?:''[^']*)*'|[(),]|[^'(),]+")
_INTEGER, _NUMBER = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """Files (and sizes) at a path, in order of name; hidden ones left out."""
    system, where = _open(path)
    info = system.get_file_info(where)
    found = system.get_file_info(pafs.FileSelector(where)) if info.type == pafs.FileType.Directory else [info]
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


def _bytes(system: pafs.FileSystem, file: str, lo: int, hi: int) -> np.ndarray:
    with system.open_input_file(file) as f:
        return np.frombuffer(f.read_at(max(0, hi - lo), lo), np.uint8)


def _outside(data: np.ndarray, inside: bool) -> np.ndarray:
    """Whether each byte stands outside texts (closing quotes count as inside, opening ones as outside)."""
    quote = data == 39
    return ((np.cumsum(quote) - quote + inside) & 1) == 0


def _headers(data: np.ndarray, outside: np.ndarray, size: int) -> list[tuple[int, str, list[str]]]:
    """End, table and columns of the column lists that begin in the first ``size`` bytes."""
    plain = lambda x: x.decode("utf-8", "replace").strip().strip('`"[]')
    table = lambda x: ".".join(map(plain, x.split(b".")))
    return [(m.end(), table(m[1]), [plain(c) for c in m[2].split(b",")]) for m in _HEADER.finditer(data.tobytes()) if m.start() < size and outside[m.start()]]


def _effect(data: np.ndarray, size: int, inside: bool) -> dict:
    """What the first ``size`` bytes do to the state: quotes, change of depth, last column list."""
    outside = _outside(data, inside)
    head = _headers(data, outside, size)
    depth = int((outside[:size] & (data[:size] == 40)).sum()) - int((outside[:size] & (data[:size] == 41)).sum())
    return {"quotes": int((data[:size] == 39).sum()), "depth": depth, "header": [head[-1][1], head[-1][2]] if head else None}


@dataclass
class Range(InputPartition):
    """Bytes of a file and the state before them."""

    file: str
    lo: int
    hi: int
    inside: bool = False
    depth: int = 0
    header: list | None = None  # table and columns


def _fields(body: str) -> list[str]:
    """The raw values of a tuple, blanks around them off."""
    out, now, depth = [], [], 0
    for token in _TOKEN.findall(body):
        if token == "," and depth == 0:
            out.append("".join(now).strip())
            now = []
            continue
        depth += (token == "(") - (token == ")")
        now.append(token)
    return [*out, "".join(now).strip()]


def _value(raw: str):
    """None, bool, int, float or str."""
    if raw[:1] == "'" and raw[-1:] == "'" and len(raw) > 1:
        return raw[1:-1].replace("''", "'")
    low = raw.lower()
    if low == "null":
        return None
    if low in ("true", "false"):
        return low == "true"
    if _INTEGER.fullmatch(raw) and -(1 << 63) <= int(raw) < 1 << 63:
        return int(raw)
    return float(raw) if _NUMBER.fullmatch(raw) else raw


def tuples(path: str, part: Range) -> Iterator[tuple[int, list[str], str]]:
    """Place, table with columns, and text between the outer parentheses, of every tuple that opens in the range."""
    system, _ = _open(path)
    beyond, behind = BEYOND, min(BEHIND, part.lo)
    before = _bytes(system, part.file, part.lo - behind, part.lo).tobytes()
    while True:
        data = _bytes(system, part.file, part.lo, part.hi + beyond)
        outside, size = _outside(data, part.inside), part.hi - part.lo
        opens, closes = outside & (data == 40), outside & (data == 41)
        depth = part.depth + np.cumsum(opens.astype(np.int32) - closes)
        start, end = np.flatnonzero(opens & (depth == 1)), np.flatnonzero(closes & (depth == 0))
        if part.depth > 0:
            end = end[1:]  # of a tuple that an earlier range has
        mine = int(np.searchsorted(start, size))
        if len(end) >= mine or len(data) < size + beyond:
            break
        beyond *= 2
    raw = data.tobytes()
    heads = _headers(data, outside, len(data))
    ends = [h[0] for h in heads]
    for s, e in zip(start[:mine].tolist(), end.tolist()):
        ahead = (before + raw[max(0, s - BEHIND) : s] if s < BEHIND else raw[s - BEHIND : s]).rstrip()
        if not (ahead.endswith(b",") or ahead[-6:].upper() == b"VALUES"):
            continue  # a column list, or a statement of another kind
        k = int(np.searchsorted(ends, s, side="right")) - 1
        header = [heads[k][1], heads[k][2]] if k >= 0 else part.header
        if header:
            yield part.lo + s, header, raw[s + 1 : e].decode("utf-8", "replace")


class DumpReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields, self.options = schema, options

    def partitions(self) -> list[Range]:
        if self.options.get("states"):
            system, where = _open(self.options["states"])
            rows = []
            for file, _ in _files(self.options["states"]):
                with system.open_input_stream(file) as f:
                    rows += [json.loads(x) for x in f.read().decode().splitlines()]
            return [Range(r["file"], r["lo"], r["hi"], r["inside"], r["depth"], json.loads(r["header"])) for r in rows]
        return [Range(file, 0, size) for file, size in _files(self.options["path"])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        names, kinds = self.fields.names, [f.dataType.typeName() for f in self.fields]
        wanted, errors = self.options.get("table"), self.options.get("errors", "false") == "true"
        arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "integer": pa.int32()}
        types = pa.schema([(n, arrow[k]) for n, k in zip(names, kinds)])
        rows = []

        def full():
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types)], schema=types)

        for at, (table, columns), body in tuples(self.options["path"], partition):
            if wanted and table != wanted and table.rpartition(".")[2] != wanted:
                continue
            raw = _fields(body)
            row = _row(raw, columns, names, kinds) if not errors else None
            if errors:
                shape = json.loads(self.options["shape"])
                if _row(raw, columns, [n for n, _ in shape], [k for _, k in shape]) is None:
                    rows.append((partition.file, at, len(raw), body))
            elif row is not None:
                rows.append(row)
            if len(rows) >= BATCH_ROWS:
                yield full()
                rows.clear()
        if rows:
            yield full()


def _row(raw: list[str], columns: list[str], names: list[str], kinds: list[str]) -> list | None:
    """Typed values in the schema's order (absent columns null), None where the tuple does not fit."""
    if len(raw) != len(columns):
        return None
    by = dict(zip(columns, raw))
    out = []
    for name, kind in zip(names, kinds):
        text = by.get(name, "null")
        v = _value(text)
        if v is None:
            out.append(None)
        elif kind == "string":
            out.append(v if isinstance(v, str) else text)
        elif kind == "double" and isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append(float(v))
        elif (kind == "long" and isinstance(v, int) and not isinstance(v, bool)) or (kind == "boolean" and isinstance(v, bool)):
            out.append(v)
        else:
            return None
    return out


def _kind(values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {bool}:
        return "boolean"
    if kinds == {int}:
        return "long"
    return "double" if kinds and kinds <= {int, float} else "string"


def infer(path: str, table: str | None = None) -> list[tuple[str, str]]:
    """Columns and types of the first INSERT statement (of ``table``), from its first INFER_ROWS tuples; none: an error."""
    system, _ = _open(path)
    names, seen = None, []
    for file, size in _files(path):
        hi = 1 << 20  # a reader stops at the tuples it needs: ranges from the file's beginning, doubled
        while True:
            seen, names = [], None
            for _, (of, columns), body in tuples(path, Range(file, 0, min(hi, size))):
                if table and of != table and of.rpartition(".")[2] != table:
                    continue
                names = names or columns
                raw = _fields(body)
                if columns == names and len(raw) == len(names):
                    seen.append([_value(x) for x in raw])
                    if len(seen) >= INFER_ROWS:
                        break
            if len(seen) >= INFER_ROWS or hi >= size:
                break
            hi *= 2
        if names:
            return [(n, _kind(list(c))) for n, c in zip(names, zip(*seen) if seen else [[] for _ in names])]
    raise ValueError(f"no INSERT statement{f' of {table}' if table else ''} in {path}")


class DumpSource(DataSource):
    """Options: path, table (default: all tables, of the first one's columns), states, errors."""

    @classmethod
    def name(cls) -> str:
        return "sql_dump"

    def schema(self) -> str:
        if self.options.get("errors", "false") == "true":
            return ERRORS
        return ", ".join(f"`{n}` {'bigint' if k == 'long' else k}" for n, k in infer(self.options["path"], self.options.get("table")))

    def reader(self, schema: StructType) -> DataSourceReader:
        return DumpReader(schema, dict(self.options))


def _states(spark: SparkSession, path: str, range_bytes: int) -> list[tuple]:
    """file, lo, hi, inside, depth, header (JSON) of every range: the first pass, and its rows put together in order."""
    cuts = [(file, lo, min(lo + range_bytes, size)) for file, size in _files(path) for lo in range(0, size, range_bytes)]

    def run(batches):
        system, _ = _open(path)
        for batch in batches:
            rows = batch.to_pylist()
            effects = []
            for r in rows:
                data = _bytes(system, r["file"], r["lo"], r["hi"] + BEYOND)
                effects.append(json.dumps([_effect(data, r["hi"] - r["lo"], inside) for inside in (False, True)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(effects, pa.string())], [*batch.schema.names, "effects"])

    ranges = spark.createDataFrame(cuts, "file string, lo long, hi long").repartition(max(1, len(cuts)), "file", "lo")
    found = sorted(tuple(r) for r in ranges.mapInArrow(run, "file string, lo long, hi long, effects string").collect())
    out, state, last = [], (False, 0, None), None
    for file, lo, hi, effects in found:
        inside, depth, header = state if file == last else (False, 0, None)
        out.append((file, lo, hi, inside, depth, json.dumps(header)))
        effect = json.loads(effects)[inside]
        state, last = ((inside + effect["quotes"]) % 2 == 1, depth + effect["depth"], effect["header"] or header), file
    return out


def read_dump(spark: SparkSession, path: str, table: str | None = None, range_bytes: int = RANGE_BYTES, errors: bool = False) -> DataFrame:
    """Typed rows of the dump at ``path``; ``errors``: the tuples that do not fit, with file and byte."""
    spark.dataSource.register(DumpSource)
    where = f"{scratch(spark)}/dump-{uuid.uuid4().hex}"
    states = _states(spark, path, range_bytes)
    spark.createDataFrame(states, "file string, lo long, hi long, inside boolean, depth int, header string").coalesce(1).write.json(where)
    reader = spark.read.format("sql_dump").option("states", where)
    if table:
        reader = reader.option("table", table)
    if errors:
        reader = reader.option("errors", "true").option("shape", json.dumps(infer(path, table)))
    return reader.load(path)
