"""Vector code compression: product quantisation in integers, with codebooks summed by treeAggregate.

Vectors are cut into PARTS equal consecutive parts, components are floor(SCALE * x). Rows are packed once into columnar blocks,
one row of a NumPy array a dimension, and stored in the shared folder. A round is one treeAggregate over the RDD of blocks: a
task adds up squared distances to the codebook's entries dimension by dimension, takes the nearest entry of each part, and
adds its parts to int64 sums and counts with np.add.at; the tensors, whose size only the codebook fixes, merge through a
reduction tree. The starting entries come from such a tree too, of the smallest identifiers of each block.

Sums and distances are exact: where a number might not fit into 64 bits, that block or tensor is one of Python's integers.

Defined results: a vector that is null or holds a null, NaN or infinite component is dropped; of a repeated vec_id the
least vector starts an entry, all its rows get a code; a null vec_id comes after all others; fewer than ENTRIES kept
identifiers make as many entries. Vectors of another length than the most frequent one (of two the greater) have no code and no
error; a length that PARTS does not divide is filled up with zeros. An error or sum beyond a long is null. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import join_hot, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows of a block, and of an Arrow batch while blocks are packed.
ROWS = 2048
#: Components up to this fit: the squared distance of a part of some thousand dimensions is below 2**63.
SMALL = 1 << 25
BLOCK = "ids array<bigint>, labels array<{}>, dim int, n int, kind string, data binary"


def _integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in the narrowest type, or as Python's integers."""
    x = x.astype(np.float64)
    top = np.abs(x).max(initial=0) * SCALE
    if top < SMALL:
        return np.floor(x * SCALE).astype(np.int16 if top < (1 << 15) - 1 else np.int32)
    return np.array([int(v) * SCALE if abs(v) >= 1 << 53 else floor(v * SCALE) for v in x.ravel().tolist()], object).reshape(x.shape)


def _packed(a: np.ndarray) -> tuple[str, bytes]:
    return ("text", ",".join(map(str, a.ravel())).encode()) if a.dtype == object else (a.dtype.str, a.tobytes())


def _unpacked(kind: str, data: bytes, dim: int, n: int) -> np.ndarray:
    """(dim, n) integers as they were packed."""
    if kind == "text":
        return np.array([int(v) for v in bytes(data).split(b",") if v], object).reshape(dim, n)
    return np.frombuffer(data, kind).reshape(dim, n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (vec_id, label, vector): the kept rows of a batch, by length."""
    for whole in batches:
        for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            vectors = batch.column(2)
            size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
            end = np.cumsum(size)
            bad = np.r_[0, np.cumsum(~np.isfinite(values))]
            kept = (bad[end] == bad[end - size]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            for dim in np.unique(size[kept]).tolist():
                rows = np.flatnonzero(kept & (size == dim))
                block = _integers(values[(end - size)[rows][None, :] + np.arange(dim)[:, None]])
                kind, data = _packed(block)
                ids, labels = (pa.array([batch.column(i).take(pa.array(rows)).to_pylist()], pa.list_(batch.column(i).type)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([kind]), pa.array([data], pa.binary())], ["ids", "labels", "dim", "n", "kind", "data"])


def packed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The stored blocks of a table of vectors."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return stored(rows.mapInArrow(_blocks, BLOCK.format(rows.schema["label"].dataType.simpleString())), "vector-blocks", {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)})


def _array(r: Row) -> np.ndarray:
    """The block's parts, (PARTS, width, n): the length is filled up with zeros."""
    a, width = _unpacked(r.kind, r.data, r.dim, r.n), -(-r.dim // PARTS)
    if width * PARTS != r.dim:
        a = np.concatenate([a, np.zeros((width * PARTS - r.dim, r.n), a.dtype)])
    return a.reshape(PARTS, width, r.n)


def _wide(*arrays: np.ndarray) -> bool:
    """Whether sums or distances of these may be beyond 64 bits."""
    return any(a.dtype == object or a.size and max(-int(a.min()), int(a.max())) >= SMALL for a in arrays)


def _kind(parts: np.ndarray, books: np.ndarray) -> type:
    """The narrowest integers that hold the squared distances."""
    if _wide(parts, books) or parts.shape[1] >= 1 << 10:
        return object
    top = sum(int(np.abs(a).max(initial=0)) for a in (parts, books))
    return np.int32 if top * top * max(parts.shape[1], 1) < 1 << 31 else np.int64


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (PARTS, n) of parts (PARTS, width, n) by books (PARTS, ENTRIES, width), ties to the lower index, and the squared distances."""
    kind = _kind(parts, books)
    parts, books, n = parts.astype(kind, copy=False), books.astype(kind, copy=False), parts.shape[2]
    codes, errors = np.zeros((PARTS, n), np.int64), np.zeros((PARTS, n), parts.dtype)
    far, gap = np.empty((books.shape[1], n), kind), np.empty((books.shape[1], n), kind)
    for p in range(PARTS):
        far[:] = 0
        for d in range(parts.shape[1]):  # one dimension after another
            np.subtract(parts[p, d][None, :], books[p, :, d][:, None], out=gap)
            np.multiply(gap, gap, out=gap)
            far += gap
        codes[p] = far.argmin(axis=0)
        errors[p] = far.min(axis=0)
    return codes, errors if kind == object else errors.astype(np.int64)


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    big = a.dtype == object or b.dtype == object or a.size and max(np.abs(a).max(), np.abs(b).max()) >= 1 << 61
    return a.astype(object) + b if big else a + b


def _summed(blocks: RDD, books: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Sums (PARTS, width, ENTRIES) and counts (PARTS, ENTRIES) of the parts of all blocks by nearest entry."""
    held = blocks.context.broadcast(books)

    def add(total, r: Row):
        parts, entries = _array(r), held.value
        codes, _ = nearest(parts, entries)
        parts = parts if parts.dtype == object else parts.astype(np.int64)
        sums = np.zeros((PARTS, parts.shape[1], entries.shape[1]), parts.dtype)
        counts = np.zeros((PARTS, entries.shape[1]), np.int64)
        for p in range(PARTS):
            np.add.at(counts[p], codes[p], 1)
            for d in range(parts.shape[1]):
                np.add.at(sums[p, d], codes[p], parts[p, d])
        return merge(total, (sums, counts))

    def merge(a, b):
        if a is None or b is None:
            return a or b
        return _merged(a[0], b[0]), a[1] + b[1]

    return blocks.treeAggregate(None, add, merge, depth=3)


def _first(blocks: RDD) -> np.ndarray:
    """The parts of the vectors of the smallest ENTRIES identifiers, (PARTS, ENTRIES, width)."""

    def least(found: dict, more: Iterable) -> dict:
        for key, v in more:
            if key not in found or v < found[key]:
                found[key] = v
        return {k: found[k] for k in sorted(found)[:ENTRIES]}

    def add(found: dict, r: Row) -> dict:
        key = lambda x: (x is None, x or 0)
        kept = sorted({key(x) for x in r.ids} | set(found))[:ENTRIES]
        rows = [i for i, x in enumerate(r.ids) if key(x) in kept]
        if not rows:
            return found
        a = _array(r)[:, :, rows]
        return least(found, ((key(r.ids[i]), tuple(map(int, a[:, :, k].ravel()))) for k, i in enumerate(rows)))

    found = blocks.treeAggregate({}, add, lambda a, b: least(a, b.items()), depth=3)
    parts = [np.array(found[k], object).reshape(PARTS, -1) for k in sorted(found)]
    books = np.stack(parts, axis=1)
    return books if _wide(books.ravel()) else books.astype(np.int64)


def trained(blocks: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds over stored blocks of one length."""
    rows = blocks.select("dim", "n", "kind", "data").rdd
    books = _first(blocks.select("ids", "dim", "n", "kind", "data").rdd)
    for _ in range(rounds):
        sums, counts = _summed(rows, books)
        means = np.moveaxis(sums // np.maximum(counts, 1)[:, None, :], 1, 2)  # floor division goes down
        new = np.where((counts > 0)[:, :, None], means, books)
        new = new.astype(object) if _wide(new) else new.astype(np.int64)
        if np.array_equal(new, books):
            break  # so would all further rounds
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(blocks: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """vec_id, label, code, error of every row of the blocks."""
    held, label = blocks.sparkSession.sparkContext.broadcast(books), blocks.schema["labels"].dataType.elementType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                r = Row(**{c: batch.column(c)[i].as_py() for c in ("dim", "n", "kind", "data")})
                texts, errors = pa.nulls(r.n, pa.string()), pa.nulls(r.n, pa.int64())
                if r.dim == dim:
                    found, far = nearest(_array(r), held.value)
                    texts = pa.array(["".join(f"{c:02x}" for c in row) for row in found.T.tolist()])
                    errors = pa.array([x if x < 1 << 63 else None for x in map(sum, far.T.tolist())], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, texts, errors], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(coded, f"vec_id long, label {label}, code string, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept row of a table of vectors."""
    blocks = packed(vectors, vec_id, vector, label)
    sizes = blocks.groupBy("dim").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = trained(blocks.filter(F.col("dim") == sizes.dim), rounds)
    key = F.concat_ws("", F.lit("="), F.col("label").cast("string"))
    out = stored(codes(blocks, books, sizes.dim).select("vec_id", F.when(F.col("label").isNull(), "-").otherwise(key).alias("label"), "code", "error"), "vector-codes")
    sums = stored(out.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    told = join_hot(out, sums, "label", "n", out.count())
    return told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES, ORACLES = {"op13_vector_codes": op13_vector_codes}, {}
