"""Media columns: documents as interleaved sequences of text and media, with the media in a content-addressed store.

parse_html turns a page into ordered items {position, kind, text, ref, caption}: runs of text, and images, audio or
video with their caption (figcaption, else alt, else title). Media bytes live in a store table keyed by their sha256;
resolve() joins items to the store on that digest and keeps position and caption beside the payload's columns. Only the
columns asked for are moved: features are computed where the payload is read, and the join carries those.

The query makes each document a page of its lines and one figure among them, which holds the whole text as a payload.

media_bytes stores any bytes without loss as a binary greyscale image of 64 samples a row (portable graymap, whose comment
holds the unpadded length), and image_features reads it back.

Defined results: null html gives an empty sequence; a reference without a stored payload resolves to nulls; a null text
is empty and is stored as one row of zeros; repeated rows repeat their result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import join_hot, small_batches, stored

ITEM = "struct<position:int,kind:string,text:string,ref:string,caption:string>"
WIDTH = 64
_MEDIA = {"img": "image", "audio": "audio", "video": "video"}
_HEAD = re.compile(rb"P5\n# bytes (\d+)\n64 (\d+)\n255\n")
FEATURES = "media_sha256 string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


class _Items(HTMLParser):
    """Collects items in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip, self.figure, self.caption = 0, None, None

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figure":
            self.figure = len(self.items) + bool("".join(self.words).strip())
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA and a.get("src"):
            self.flush()
            self.items.append({"kind": _MEDIA[tag], "text": None, "ref": a["src"], "caption": a.get("alt") or a.get("title")})
        elif tag in ("p", "div", "br", "h1", "h2", "h3", "li", "tr", "section", "article"):
            self.words.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            for item in self.items[self.figure or 0 :]:
                if item["kind"] != "text" and text:
                    item["caption"] = text
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse_html(html: str | None) -> list[dict]:
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"position": i} | x for i, x in enumerate(p.items)]


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and items, the ordered sequence of each page."""
    small_batches(pages.sparkSession)
    kind = pages.schema[key].dataType

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([parse_html(x) for x in batch.column(1).to_pylist()], item)], [key, "items"])

    return pages.select(key, html).mapInArrow(parse, f"{key} {kind.simpleString()}, items array<{ITEM}>")


def resolve(seqs: DataFrame, catalog: DataFrame, key: str, digest: str = "media_sha256", texts: bool = True) -> DataFrame:
    """One row an item: key, the item's fields, and the catalog's columns for media; catalog has one row a digest. Without texts, of media only; their positions are those in the whole sequence."""
    items = seqs.select(key, F.explode("items").alias("item")).select(key, "item.*")
    refs = stored(items.filter("kind <> 'text'").withColumn(digest, F.regexp_replace("ref", "^sha256:", "")), "media-refs")
    uses = stored(refs.groupBy(digest).agg(F.count(F.lit(1)).alias("uses")), "media-uses")
    found = join_hot(refs, uses.join(catalog, digest), digest, "uses", refs.count()).drop("uses")
    return found.unionByName(items.filter("kind = 'text'"), allowMissingColumns=True) if texts else found


def media_bytes(text: Column) -> Column:
    """The text's UTF-8 bytes as a graymap: rows of 64 samples, the last filled up with 0, at least one row."""
    raw = F.encode(F.coalesce(text, F.lit("")), "utf-8")
    n = F.length(raw)
    fill = F.when(n == 0, F.lit(WIDTH)).otherwise((WIDTH - n % WIDTH) % WIDTH)
    rows = ((n + fill) / WIDTH).cast("int")
    head = F.format_string("P5\n# bytes %d\n64 %d\n255\n", n, rows)
    return F.concat(F.encode(head, "utf-8"), raw, F.unhex(F.repeat(F.lit("00"), fill)))


def read_image(media: bytes) -> tuple[int, np.ndarray]:
    """Unpadded length and samples of a stored image."""
    m = _HEAD.match(media)
    if not m:
        raise ValueError("not a stored payload")
    samples = np.frombuffer(media, np.uint8, offset=m.end())
    if len(samples) != WIDTH * int(m[2]):
        raise ValueError("the stored payload is cut off")
    return int(m[1]), samples


def image_features(store: DataFrame) -> DataFrame:
    """FEATURES for every row of store(media_sha256, media), from the bytes as read back. The feature has the image's height, sum, sum of horizontal steps and a histogram of 16 bins."""
    small_batches(store.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for media in (x.as_buffer() for x in batch.column(0)):
                n, a = read_image(media)
                steps = int(np.abs(np.diff(a.reshape(-1, WIDTH).astype(np.int16), axis=1)).sum())
                hist = ",".join(map(str, np.bincount(a >> 4, minlength=16)))
                out.append((hashlib.sha256(media).hexdigest(), n, len(a), hashlib.sha256(a).hexdigest(), zlib.crc32(a[-WIDTH:]), media.size, f"h={len(a) // WIDTH};sum={int(a.sum(dtype=np.int64))};steps={steps};hist={hist}"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["media_sha256", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return store.select("media").mapInArrow(features, FEATURES)


def page_of(text: Column, ref: Column, doc_id: Column) -> Column:
    """A document as a page: its lines are paragraphs, and its stored payload is a figure behind the first half of them."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(plain, "\n")
    half = (F.size(lines) / 2).cast("int")
    marked = lambda part: F.array_join(F.transform(part, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "")
    caption = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(", behind line "), half.cast("string"))
    figure = F.concat(F.lit('<figure><img src="sha256:'), ref, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure>"))
    return F.concat(marked(F.slice(lines, 1, half)), figure, marked(F.slice(lines, half + 1, F.size(lines))))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = docs.select("doc_id", media_bytes(F.col("text")).alias("media")).withColumn("media_sha256", F.sha2("media", 256))
    store = stored(made, "media-store", compression="zstd")
    small_batches(spark)
    catalog = image_features(store)
    catalog = catalog.groupBy("media_sha256").agg(*[F.first(c).alias(c) for c in catalog.columns[1:]])
    own = docs.withColumn("media_sha256", F.sha2(media_bytes(F.col("text")), 256))
    pages = own.select("doc_id", page_of(F.col("text"), F.col("media_sha256"), F.col("doc_id")).alias("html"))
    found = resolve(sequences(pages, "doc_id"), catalog, "doc_id", texts=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")


QUERIES, ORACLES = {"op3_media_columns": op3_media_columns}, {}
