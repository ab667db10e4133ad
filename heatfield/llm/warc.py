"""WARC archives: a deterministic sharded writer, and its reader.

A narrow table of keys and digests comes first: of equal payloads the page with the smallest number is the response, the others
revisit it and carry no payload through the shuffle. Keys are put in order by ranges and their bytes summed up, which cuts the
order into shards of equal work whose bounds depend on the pages alone, not on tasks or partitions. Pages are then dealt to their
shards and sorted; a task regenerates headers and digests, writes one gzip member a record and rolls to the next file when the
compressed size is reached. Equal pages give equal files, byte for byte.

Files are written under temporary names and renamed when whole; the manifest (files, records, sizes, SHA-256) is written
beside and renamed last. Without a manifest there is no archive, and the reader takes the manifest's files only and checks
their digests, each record's block and payload digests, and that each revisit's response is there.

Defined results: a null html is an empty payload; a null page_id comes after all others and is read back as null; rows with the
same page_id and payload but another url are ordered by url (null as empty), the first counts; of rows equal in page_id, url and
html the first is what the group says and the others revisit the group's response; below `least` bytes all are responses. An empty
table gives an archive without files; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatfield.llm.common import BROADCAST_ROWS, join_hot, scratch, stored

#: Compressed bytes at which a file is full; least bytes of a shard and most shards; what a record has beside its payload, about.
ROLL, SHARD, SHARDS, HEAD = 1 << 30, 8 << 20, 4096, 512
DATE = "2000-01-01T00:00:00Z"
#: Fixed values of the format.
CRLF, VERSION, PROFILE = b"\r\n", b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = ("late", "page", "link", "sha")
MANIFEST = "file string, shard int, seq int, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_id string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields), f"WARC-Block-Digest: sha1:{base32_sha1(block)}".encode(), f"Content-Length: {len(block)}".encode()]
    return gzip.compress(CRLF.join([*head, b"", block, b"", b""]), 6, mtime=0)


def record_id(page_id: int | None, digest: str, more: str = "") -> str:
    """The identifier of a page's record: its number can be read off it."""
    return f"<urn:page:{'-' if page_id is None else page_id}:{digest}{more}>"


def page_record(page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, head: tuple | None, more: str) -> bytes:
    """The response with a payload, or the revisit of head (page_id, url). The digest is made anew where there is a payload."""
    digest = digest if payload is None else base32_sha1(payload)
    target = lambda p, u: quote(u, safe="!#$%&'()*+,/:;=?@[]~") if u else f"urn:page:{'-' if p is None else p}"
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, more)), ("WARC-Date", DATE), ("WARC-Target-URI", target(page_id, url)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(head[0], digest)), ("WARC-Refers-To-Target-URI", target(*head)), ("WARC-Refers-To-Date", DATE)]
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", f"Content-Length: {n_bytes}".encode(), b"", b""])
    return _record(fields, http + (payload or b""))


class _Files:
    """A shard's files, one after another."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.root = pa.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.shard, self.roll, self.seq, self.out, self.done = shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out and self.size + len(member) > self.roll:
            self.close()
        if not self.out:
            self.name = f"shard-{self.shard:05d}-{self.seq:04d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        """Puts the file in its place; an earlier attempt's file there has the same bytes."""
        if self.out:
            self.out.close()
            self.out = None
            try:
                self.fs.move(self.temp, f"{self.root}/{self.name}")
            except OSError:
                if self.fs.get_file_info(f"{self.root}/{self.name}").size != self.size:
                    raise
                self.fs.delete_file(self.temp)
            self.done.append((self.name, self.shard, self.seq, self.records, self.size, self.sha.hexdigest()))
            self.seq += 1


def _keyed(pages: DataFrame) -> DataFrame:
    """Pages with their place in the order (KEY), SHA-1 and size of the payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = {"late": F.col("page_id").isNull(), "page": F.coalesce("page_id", F.lit(0).cast("long")), "link": F.coalesce("url", F.lit("")), "sha": F.unhex(F.sha2("payload", 256)), "sha1": F.unhex(F.sha1("payload")), "n_bytes": F.length("payload").cast("long")}
    return rows.withColumns(own)


def _with_heads(rows: DataFrame, heads: DataFrame, few: bool, total: int) -> DataFrame:
    """rows with head, the page that has the response: null where a payload stands alone."""
    if few:
        return rows.join(F.broadcast(heads.drop("n")), "sha", "left")
    return join_hot(rows, heads, "sha", "n", total).drop("n")


def _bounds(narrow: DataFrame, shard: int) -> list[tuple]:
    """The first key of every shard but the first: SHARDS of them at most."""
    total = narrow.agg(F.sum("weight")).first()[0] or 0
    step = max(shard, -(-total // SHARDS))
    ranged = stored(narrow.repartitionByRange(*KEY).sortWithinPartitions(*KEY).withColumn("at", F.monotonically_increasing_id()), "archive-order")
    ranged = ranged.withColumn("range", F.shiftright("at", 33))
    sizes = ranged.groupBy("range").agg(F.sum("weight").alias("n"))  # a row a range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    run = F.sum("weight").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("run", run - F.col("weight")).join(F.broadcast(before), "range")
    first = placed.groupBy(F.floor((F.col("before") + F.col("run")) / step).alias("shard")).agg(F.min(F.struct(*KEY)).alias("key"))
    return sorted({(r.key.late, r.key.page, r.key.link, bytes(r.key.sha)) for r in first.filter("shard > 0").collect()})


def write_archive(pages: DataFrame, folder: str, least: int = 0, roll: int = ROLL, shard: int = SHARD) -> DataFrame:
    """Writes pages(page_id, url, html) under the URI folder and returns the manifest."""
    spark, keyed = pages.sparkSession, _keyed(pages)
    narrow = stored(keyed.select(*KEY, "n_bytes"), "archive-keys")
    total = narrow.count()
    groups = narrow.filter(F.col("n_bytes") >= least).groupBy("sha").agg(F.min(F.struct("late", "page", "link")).alias("head"), F.count(F.lit(1)).alias("n"))
    heads = stored(groups.filter("n > 1"), "archive-heads")
    few = heads.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    is_head = F.col("head").isNull() | (F.struct("late", "page", "link") == F.col("head"))
    bounds = _bounds(_with_heads(narrow, heads, few, total).select(*KEY, (F.when(is_head, F.col("n_bytes")).otherwise(0) + HEAD).alias("weight")), shard)
    repeats = stored(narrow.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies"), "archive-repeats")

    columns = [*KEY, "page_id", "url", "sha1", "n_bytes"]
    rows = _with_heads(keyed, heads, few, total).select(*columns, "head", F.when(is_head, F.col("payload")).alias("payload"))
    if repeats.isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        # Equal rows are counted before they are dealt, so that one task never gets a hot one's payload many times.
        many = rows.join(repeats, list(KEY), "left_semi").groupBy(*columns, "head").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("copies"))
        rows = rows.join(repeats, list(KEY), "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(many)
    held = spark.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def place(late: pd.Series, page: pd.Series, link: pd.Series, sha: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(held.value, (a, b, c, bytes(d))) for a, b, c, d in zip(late, page, link, sha, strict=True)], dtype="int32")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if files is None or files.shard != r["shard"]:
                    if files:
                        files.close()
                        done += files.done
                    files = _Files(folder, r["shard"], roll)
                digest, head = base64.b32encode(r["sha1"]).decode(), r["head"]
                origin = (r["page_id"], r["url"]) if head is None else (None if head["late"] else head["page"], head["link"])
                mark = f":{hashlib.md5(r['link'].encode()).hexdigest()[:12]}"
                for k in range(r["copies"]):
                    first = k == 0 or r["n_bytes"] < least
                    more = "" if r["payload"] is not None and k == 0 and r["n_bytes"] >= least else f"{mark}.{k}"
                    files.add(page_record(r["page_id"], r["url"], r["payload"] if first else None, r["n_bytes"], digest, origin, more))
        if files:
            files.close()
            done += files.done
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "seq", "records", "bytes", "sha256"), d, strict=True)) for d in done], pa.schema([("file", pa.string()), ("shard", pa.int32()), ("seq", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    dealt = rows.withColumn("shard", place(*KEY)).repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", *KEY)
    made = stored(dealt.mapInArrow(write, MANIFEST), "archive-files", {"spark.sql.execution.arrow.maxRecordsPerBatch": "128"})
    commit(made, folder)
    return manifest(spark, folder)


def _renamed(spark: SparkSession, old: str, new: str) -> bool:
    """False if new is there already."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(old).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(path(new)) and fs.rename(path(old), path(new))


def commit(made: DataFrame, folder: str) -> None:
    """Writes the manifest beside and renames it: from then on the archive is there."""
    beside = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    made.coalesce(1).write.json(beside)  # one narrow row a file
    if not _renamed(made.sparkSession, beside, f"{folder}/manifest"):
        raise OSError(f"the manifest of {folder} was not put in place")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def members(source, expected: str | None = None) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time, whose bytes must have the SHA-256 expected."""
    sha, one, parts = hashlib.sha256(), zlib.decompressobj(31), []
    while data := source.read(1 << 20):
        sha.update(data)
        while data:
            parts.append(one.decompress(data))
            data = one.unused_data
            if one.eof:
                yield b"".join(parts)
                one, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the file ends within a record")
    if expected and sha.hexdigest() != expected:
        raise ValueError("the file is not that of the manifest")


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the block, whose digest is checked."""
    head, _, rest = record.partition(CRLF * 2)
    version, *lines = head.split(CRLF)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    if version != VERSION or rest[len(block) :] != CRLF * 2 or fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError(f"a damaged record: {fields.get('warc-record-id')}")
    return fields, block


def _page(name: str) -> int | None:
    number = name.split(":")[2]
    return None if number == "-" else int(number)


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """A row of RECORD of a response or revisit."""
    http, _, payload = block.partition(CRLF * 2)
    size = next(int(x.partition(b":")[2]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    kind, name, digest, to = fields["warc-type"], fields["warc-record-id"], fields["warc-payload-digest"].removeprefix("sha1:"), fields.get("warc-refers-to")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"a damaged payload: {name}")
    return _page(name), size, digest, kind, _page(to) if to else None, name, to


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page's record."""
    files = manifest(spark, folder)
    count, schema = files.count(), pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_id", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, records, sha in zip(*(batch.column(c).to_pylist() for c in ("file", "records", "sha256")), strict=True):
                fs, root = pa.fs.FileSystem.from_uri(folder)
                rows, n = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as source:
                    for record in members(source, sha):
                        fields, block = parsed(record)
                        if fields["warc-type"] in ("response", "revisit"):
                            rows.append(page_of(fields, block))
                            n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []
                if n != records:
                    raise ValueError(f"{name} has {n} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = stored(files.select("file", "records", "sha256").repartition(max(1, min(count, 1 << 14))).mapInArrow(read, RECORD), "archive-records")
    asked = found.filter("record_type = 'revisit'").select(F.col("refers_id").alias("record_id"), "payload_digest", "payload_bytes").distinct()
    there = found.filter("record_type = 'response'").select("record_id", "payload_digest", "payload_bytes")
    if not asked.join(there, ["record_id", "payload_digest", "payload_bytes"], "left_anti").isEmpty():
        raise ValueError("a revisit without its response")
    return found.drop("record_id", "refers_id")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder)


QUERIES, ORACLES = {"op12_warc": op12_warc}, {}
