"""Exact dedup over a log-structured merge index of text digests.

Documents arrive in WAVES. A flush writes each task's memtable of a wave as a run sorted by digest, with one row a
document, and the run's filter: the bits of a hash of its digests. Compaction merges the runs into one
row a digest that holds the identifier to keep and the group's size. Filters say which rows need no further look: a
digest whose bit only one row of all runs sets has no copy, is merged with nothing and never shuffled. A hit is two rows of one
digest; the bytes of all texts of a hit are compared (their least and greatest must agree, which needs one text a
digest and task in the shuffle), and digests whose texts differ are divided by the text itself.

Defined results: a null text is empty; a null doc_id is never kept before another one, and a group that has only such
rows keeps null; rows that repeat both doc_id and text are one document and get the same answer; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import BROADCAST_ROWS, ascii_lower, distinct_rows, join_hot, row_key, scratch, stored

#: Flushes of a table; bits of the filters, a power of 2 whose words of 64 bits are few enough to be broadcast.
WAVES, FILTER_BITS = 4, 24
ROW = "struct<late: boolean, doc_id: bigint, key: bigint>"
RUN_SCHEMA = f"digest binary, one {ROW}, copies bigint"


def _bit(digest: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(digest), 64 - FILTER_BITS)


class DigestIndex:
    """Runs, filters and compactions of one index, in a folder that the whole cluster shares."""

    def __init__(self, spark: SparkSession, root: str | None = None, digest_bytes: int = 32, keep: str = "smallest"):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep must be smallest or largest")
        self.spark, self.root = spark, root or scratch(spark, "digest-index")
        self.digest_bytes, self.runs, self.smallest = digest_bytes, 0, keep == "smallest"

    def first(self, c: str) -> Column:
        """The row to keep: a null doc_id (late) comes after all others."""
        return F.min(c) if self.smallest else F.max(c)

    def digests(self, docs: DataFrame, *also: str) -> DataFrame:
        """sha, doc_id, key, digest and one (the row as the index knows it) of each row of docs(doc_id, text)."""
        sha = F.unhex(F.sha2(ascii_lower(docs["text"]), 256))
        rows = docs.select(sha.alias("sha"), docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("key"), *also)
        late = F.col("doc_id").isNull() if self.smallest else F.col("doc_id").isNotNull()
        return rows.withColumns({"digest": F.substring("sha", 1, self.digest_bytes), "one": F.struct(late.alias("late"), "doc_id", "key")})

    def flush(self, digests: DataFrame) -> None:
        """Adds rows with digest and one as sorted runs, one to a task, and their filter: how often each bit is set, up to 2."""
        rows = digests.select("digest", "one", F.lit(1).cast("long").alias("copies"))
        rows.sortWithinPartitions("digest").write.parquet(f"{self.root}/run-{self.runs:06d}")
        bits = self.run(self.runs).groupBy(_bit(F.col("digest")).alias("bit")).agg(F.least(F.sum("copies"), F.lit(2)).alias("n"))
        bits.groupBy((F.col("bit") / 64).cast("int").alias("word")).agg(_bits("n >= 1").alias("one"), _bits("n >= 2").alias("two")).write.parquet(f"{self.root}/filter-{self.runs:06d}")
        self.runs += 1

    def run(self, i: int) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(f"{self.root}/run-{i:06d}")

    def entries(self) -> DataFrame:
        """All rows of all runs."""
        return self.spark.read.schema(RUN_SCHEMA).parquet(*[f"{self.root}/run-{i:06d}" for i in range(self.runs)])

    def filters(self) -> DataFrame:
        """word, and of its 64 bits those that some row sets (one) and that several rows set (two): 2**FILTER_BITS / 64 rows at most."""
        every = self.spark.read.schema("word int, one long, two long").parquet(*[f"{self.root}/filter-{i:06d}" for i in range(self.runs)])
        runs = every.groupBy("word").agg(F.collect_list(F.struct("one", "two")).alias("runs"))  # one a run
        both = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two")), lambda t, x: F.struct(t["one"].bitwiseOR(x["one"]).alias("one"), t["two"].bitwiseOR(x["two"]).bitwiseOR(t["one"].bitwiseAND(x["one"])).alias("two")))
        return runs.select("word", both.alias("bits")).select("word", "bits.*")

    def split(self, rows: DataFrame, bits: str) -> tuple[DataFrame, DataFrame]:
        """rows(digest) that the filter's bits let through, and the others. The filters are of fixed size."""
        word = F.broadcast(stored(self.filters(), "filter").select((F.col("word")).alias("_word"), F.col(bits).alias("_bits")))
        bit = _bit(F.col("digest"))
        seen = rows.withColumns({"_word": (bit / 64).cast("int"), "_at": (bit % 64).cast("int")}).join(word, "_word", "left")
        hit = F.shiftright(F.col("_bits"), 0).isNotNull() & F.expr("getbit(_bits, _at) = 1")
        return seen.filter(hit).select(*rows.columns), seen.filter(F.coalesce(~hit, F.lit(True))).select(*rows.columns)

    def compact(self) -> DataFrame:
        """digest, one, copies of every digest that several rows may have. The aggregate combines before it shuffles, so a hot digest is one row a task."""
        maybe, _ = self.split(self.entries(), "two")
        return stored(maybe.groupBy("digest").agg(self.first("one").alias("one"), F.sum("copies").alias("copies")).sortWithinPartitions("digest"), "compacted")

    def lookup(self, digests: DataFrame) -> DataFrame:
        """Rows of the runs with one of these digests (binary column digest), which the filters let through first."""
        maybe, _ = self.split(digests.select("digest"), "one")
        return self.entries().join(maybe.distinct(), "digest", "left_semi")

    def collisions(self, docs: DataFrame, hits: DataFrame) -> DataFrame:
        """The digests of hits whose texts are not the same bytes."""
        text = self.digests(docs.select("doc_id", "text", ascii_lower(docs["text"]).alias("norm")), "norm").select("digest", "norm")
        if hits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            found = text.join(F.broadcast(hits.select("digest")), "digest", "left_semi")
        else:  # no join by digest, which would carry a hot digest's texts to one task: the aggregate sends two of each task
            found, _ = self.split(text, "two")
        same = found.groupBy("digest").agg((F.min("norm") == F.max("norm")).alias("same"))
        return stored(same.filter(~F.col("same")).select("digest"), "collisions")


def _bits(when: str) -> Column:
    return F.expr(f"bit_or(if({when}, shiftleft(1L, cast(bit % 64 as int)), 0L))")


def grouped(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """doc_id, key, sha, one (doc_id and key of the row to keep), group_size for every row of docs(doc_id, text)."""
    index = DigestIndex(docs.sparkSession, digest_bytes=digest_bytes, keep=keep)
    digests = stored(index.digests(docs), "digests")
    for wave in range(WAVES):
        index.flush(digests.filter(F.pmod(F.hash("key"), F.lit(WAVES)) == wave))
    hits = stored(index.compact().filter("copies > 1"), "hits")
    bad = index.collisions(docs, hits)
    split = None
    if not bad.isEmpty():
        # Few or no digests ever get here: their rows are grouped by the text itself.
        texts = docs.select("doc_id", "text", ascii_lower(docs["text"]).alias("norm"))
        rows = index.digests(texts, "norm").join(bad, "digest", "left_semi")
        split = rows.groupBy("digest", "norm").agg(index.first("one").alias("keep"), F.count(F.lit(1)).alias("group_size"))
        split = rows.join(split, ["digest", "norm"]).select("doc_id", "key", "sha", "keep", "group_size")
        digests, hits = digests.join(bad, "digest", "left_anti"), hits.join(bad, "digest", "left_anti")
    maybe, none = index.split(digests.select("digest", "doc_id", "key", "sha"), "two")
    found = join_hot(maybe, hits.select("digest", F.col("one").alias("keep"), F.col("copies").alias("group_size")), "digest", "group_size", digests.count())
    alone = none.withColumns({"keep": F.lit(None).cast(ROW), "group_size": F.lit(None).cast("long")})
    columns = ["doc_id", "key", "sha", "keep", "group_size"]
    out = found.select(*columns).unionByName(alone.select(*columns))
    out = out.unionByName(split) if split is not None else out
    own = F.struct(F.col("doc_id").alias("doc_id"), F.col("key").alias("key"))
    one = F.when(F.col("group_size").isNull(), own).otherwise(F.struct(F.col("keep.doc_id").alias("doc_id"), F.col("keep.key").alias("key")))
    return out.select("doc_id", "key", "sha", one.alias("one"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))


def exact_dedup(docs: DataFrame, keep: str = "smallest", digest_bytes: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs(doc_id, text).

    digest_bytes below 32 shortens the digest (tests use it to force collisions); the answer does not depend on it.
    """
    out = grouped(docs, keep, digest_bytes)
    return out.select("doc_id", F.col("one.doc_id").alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(F.col("one.doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of rows with equal texts one with the smallest doc_id (null only where there is no other)."""
    found = stored(grouped(docs).filter("key <> one.key").select("key").distinct(), "gone")
    return distinct_rows(docs, found)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="largest")


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
QUERIES, ORACLES = {"op1_exact_dedup": op1_exact_dedup}, {"op1_exact_dedup": SQL}
