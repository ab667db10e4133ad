"""Shared pieces: scratch tables in the cluster's shared folder, checked broadcasts and joins that survive a hot key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.sources.files import scratch

#: A key with at least 1/HOT_SHARE of all rows is hot. There are at most HOT_SHARE such keys, which bounds the broadcast.
HOT_SHARE = 512
#: Most rows that a narrow table may have to be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str, settings: dict[str, str] | None = None, **options: str) -> DataFrame:
    """df written to the shared folder and read back: it cuts the lineage and outlives any executor.

    The write's own shuffle files go as it ends, and settings hold for the write alone.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that no frame in use reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound what a Python worker holds: so many whole texts to an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else as it is, for a shuffle join. df should be stored()."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """left joined with right, which has one row a key and in `size` that key's number of rows on the left.

    The few keys with 1/HOT_SHARE of `total` rows or more meet a broadcast of at most HOT_SHARE rows, so no task gets
    a hot key whole; all other keys take a shuffle join.
    """
    hot = right.filter(F.col(size) * HOT_SHARE >= F.lit(max(total, HOT_SHARE * 64)))
    cold = right.filter(F.col(size) * HOT_SHARE < F.lit(max(total, HOT_SHARE * 64)))
    one = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return one.unionByName(rest.select(one.columns))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def row_key(rows: DataFrame) -> Column:
    """A number that is the same for rows with the same doc_id and text only, whatever else they hold; doc_id may be null or repeat."""
    return F.xxhash64(rows["doc_id"].cast("long"), rows["text"].cast("string"))


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in the stored table keys."""
    return df.join(checked_broadcast(keys.select(key)), key, "left_anti").select(*df.columns)


def held_by(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in the stored table keys."""
    return df.join(checked_broadcast(keys.select(key)), key, "left_semi").select(*df.columns)


def distinct_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """One row of docs for each row_key that is not in the stored table gone(key)."""
    name = next(x for x in (f"row_key_{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    left = without(docs.withColumn(name, row_key(docs)), gone.withColumnRenamed("key", name), name)
    again = stored(left.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(name), "repeated")
    if again.isEmpty():
        return left.drop(name)
    return without(left, again, name).unionByName(held_by(left, again, name).dropDuplicates([name])).drop(name)


#: Odd numbers whose bits look random.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_STEP = 1 << 18


def _tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        size, base = 1 << (n - 1).bit_length(), int(ODD[0])
        for i, x in enumerate((base, pow(base, -1, 1 << 64))):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def prefix_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of b[start:end] for ordered, disjoint stretches of bytes: polynomials read off prefix sums."""
    out, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        zero = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, zero + _STEP, "right")))  # some at a time, for the cache
        s, e = start[at:to] - zero, end[at:to] - zero
        part = b[zero : zero + int(e[-1])]
        up, down = _tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[e] - sums[s]) * down[s]
        h = (h ^ (h >> np.uint64(32))) * ODD[1]
        out[at:to] = h ^ (h >> np.uint64(29))
        at = to
    return out
