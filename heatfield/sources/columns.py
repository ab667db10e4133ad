"""Typed columns as a data source: fixed-width little-endian arrays, one behind another, that a reader maps without parsing.

A task writes its rows as chunks: files that hold each column's values at an offset that ALIGN divides. The manifest,
columns.json, has the chunks in the order of the rows with names, kinds, offsets, lengths and sizes, and is put in place when all
tasks are done; chunks that it does not name are never read. A null is the kind's greatest value, or its least where it has a
sign, so a real value of that size, or one beyond the kind, is an error.

    df.write.format("typed_columns").option("kinds", "x:i16,cause:u8").save(uri)
    spark.read.format("typed_columns").load(uri)
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed values of the format: numpy types by kind, and what each column's offset is a multiple of.
KINDS = {"u8": "<u1", "i8": "<i1", "u16": "<u2", "i16": "<i2", "u32": "<u4", "i32": "<i4"}
ALIGN = 8
#: Most rows of a chunk, and of an Arrow batch that is read.
CHUNK, BATCH = 1 << 20, 1 << 16


def null_of(kind: str) -> int:
    """The value that stands for null."""
    limits = np.iinfo(KINDS[kind])
    return int(limits.max if limits.min == 0 else limits.min)


def packed(name: str, kind: str, values: pa.Array) -> bytes:
    """A column's bytes; a value that the kind cannot hold is an error."""
    limits, none = np.iinfo(KINDS[kind]), null_of(kind)
    known = values.drop_null().to_numpy(zero_copy_only=False)
    if len(known) and (known.min() < limits.min or known.max() > limits.max or (known == none).any()):
        raise ValueError(f"{name}: {kind} cannot hold {int(known.min())} to {int(known.max())}")
    return values.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False).astype(KINDS[kind]).tobytes()


def chunk(table: pa.Table, kinds: dict[str, str]) -> tuple[bytes, list[dict]]:
    """The bytes of a chunk and its columns' entries."""
    parts, entries, at = [], [], 0
    for name, kind in kinds.items():
        parts.append(b"\0" * (-at % ALIGN))
        at += len(parts[-1])
        entries.append({"name": name, "type": kind, "offset": at, "length": table.num_rows})
        parts.append(packed(name, kind, table.column(name).combine_chunks()))
        at += len(parts[-1])
    return b"".join(parts), entries


def views(data: bytes, part: dict, kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """A chunk's columns as views of its bytes; anything that does not fit is an error."""
    if len(data) != part["bytes"]:
        raise ValueError(f"{part['file']} has {len(data)} bytes, not {part['bytes']}")
    out: dict[str, np.ndarray] = {}
    for c in part["columns"]:
        kind = kinds.get(c["name"])
        if kind is None or kind != c["type"] or c["name"] in out:
            raise ValueError(f"{part['file']}: no column {c['name']} of {c['type']}")
        size = np.dtype(KINDS[kind]).itemsize
        if c["length"] != part["rows"] or c["offset"] < 0 or c["offset"] % ALIGN or c["offset"] + c["length"] * size > len(data):
            raise ValueError(f"{part['file']}: {c['name']} is out of bounds")
        out[c["name"]] = np.frombuffer(data, KINDS[kind], c["length"], c["offset"])
    if set(out) != set(kinds):
        raise ValueError(f"{part['file']} lacks columns")
    return out


def _manifest(uri: str) -> dict:
    fs, root = pa.fs.FileSystem.from_uri(uri)
    with fs.open_input_stream(f"{root}/columns.json") as f:
        said = json.loads(f.read())
    if said.get("version") != 1 or not all(k in KINDS for k in said["kinds"].values()) or said["rows"] != sum(c["rows"] for c in said["chunks"]):
        raise ValueError(f"{uri} has a manifest that does not agree with itself")
    return said


@dataclass
class _Done(WriterCommitMessage):
    chunks: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, kinds: dict[str, str], overwrite: bool, compress: bool):
        self.uri, self.kinds, self.overwrite, self.compress = uri, kinds, overwrite, compress

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(root, recursive=True)
        part, held, done = TaskContext.get().partitionId(), [], []

        def flush() -> None:
            table = pa.Table.from_batches(held)
            data, entries = chunk(table, self.kinds)
            name = f"chunk-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(gzip.compress(data, mtime=0) if self.compress else data)
            done.append({"file": name, "rows": table.num_rows, "bytes": len(data), "columns": entries, "at": [part, len(done)]})
            held.clear()

        for batch in iterator:
            while batch.num_rows:
                room = CHUNK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == CHUNK:
                    flush()
        if held:
            flush()
        return _Done(done)

    def commit(self, messages: list[_Done | None]) -> None:
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        fs.create_dir(root, recursive=True)
        old = fs.get_file_info(f"{root}/columns.json").type != pa.fs.FileType.NotFound
        before = [c["file"] for c in _manifest(self.uri)["chunks"]] if old else []
        if old and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.uri} holds columns")
        chunks = sorted((c for m in messages if m for c in m.chunks), key=lambda c: c.pop("at"))
        said = {"version": 1, "rows": sum(c["rows"] for c in chunks), "gzip": self.compress, "kinds": self.kinds, "chunks": chunks}
        with fs.open_output_stream(f"{root}/columns.json.new", compression=None) as f:
            f.write(json.dumps(said).encode())
        fs.move(f"{root}/columns.json.new", f"{root}/columns.json")
        for name in before:
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[_Done | None]) -> None:
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        for c in (c for m in messages if m for c in m.chunks):
            fs.delete_file(f"{root}/{c['file']}")


@dataclass
class _Chunk(InputPartition):
    part: dict


class _Reader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType):
        self.uri, self.schema, self.said = uri, schema, _manifest(uri)

    def partitions(self) -> list[_Chunk]:
        return [_Chunk(c) for c in self.said["chunks"]] or [_Chunk({})]

    def read(self, partition: _Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.part:
            return
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        with fs.open_input_stream(f"{root}/{partition.part['file']}", compression=None) as f:
            data = f.read()
        found = views(gzip.decompress(data) if self.said["gzip"] else data, partition.part, self.said["kinds"])
        names = self.schema.names
        for i in range(0, partition.part["rows"], BATCH):
            arrays = []
            for name in names:
                kind, v = self.said["kinds"][name], found[name][i : i + BATCH]
                arrays.append(pa.array(v.astype(np.int64), mask=v == null_of(kind)).cast(pa.int64() if kind == "u32" else pa.int32(), safe=False))
            yield pa.RecordBatch.from_arrays(arrays, names)


class TypedColumns(DataSource):
    """Options: path (a URI), and to write kinds ("name:kind,..."; the columns in order) and gzip (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "typed_columns"

    def _uri(self) -> str:
        path = self.options["path"]
        return path if "://" in path else f"file://{path}"

    def schema(self) -> str:
        return ", ".join(f"`{n}` {'long' if k == 'u32' else 'int'}" for n, k in _manifest(self._uri())["kinds"].items())

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self._uri(), schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        kinds = dict(x.split(":") for x in self.options["kinds"].split(","))
        if unknown := [n for n, k in kinds.items() if n not in schema.names or k not in KINDS]:
            raise ValueError(f"no such columns or kinds: {unknown}")
        return _Writer(self._uri(), kinds, overwrite, self.options.get("gzip", "false") == "true")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TypedColumns)
