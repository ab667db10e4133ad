"""Spelling variant grouping: words that one inserted, deleted or replaced code point makes alike, found by deletion keys.

Words of the corpus are counted with a map-side combine. Prefix sums of a polynomial over all code points of a batch give every
word's hash and, from prefix and suffix, its hash without each code point, as integers in NumPy. These keys are dealt to
partitions by their leading bits and sorted. In a run of equal keys the strings themselves are compared, so a
collision joins nothing. Two words that differ by a replacement share the string and the place without it; a word that
is another's string without a code point has one less. So a run is a few small stars, bounded by the
alphabet whatever the corpus: its members get their number of near words and the best of them, and no pairs are made.
Forms are followed to their roots by pointer doubling.

A key carries its word only up to LONG code points. Longer words send a digest in its place, meet in joins, and are compared
by edit distance; a word of LONG code points takes both ways, so no link between the two is lost.

Defined results: a null text has no words; a null doc_id is written as nothing before the colon; repeated rows count
again; of near words with the same count the smallest in code-point order is the form; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import LOWER, ODD, UPPER, _tables, checked_broadcast, forget, stored

#: Letters of a word; least code points and occurrences; of so many (document, run) pairs one loses a code point; times that a form is as frequent.
LETTERS, SHORTEST, LEAST, EVERY, TIMES = r"[A-Za-zÀ-ÿ]", 5, 3, 97, 2
#: Code points up to which keys carry the word; code points hashed at a time.
LONG, STEP = 64, 1 << 16
NEAR = "word string, n long, near long, other_n long, other string"


def words(docs: DataFrame) -> DataFrame:
    """word, n of docs(doc_id, text)."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = "cast(h % length(run) as int)"
    found = h.select(F.when(F.col("h") % EVERY == 0, F.expr(f"concat(substring(run, 1, {at}), substring(run, {at} + 2))")).otherwise(F.col("run")).alias("word"))
    return found.filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[1]
    return h ^ (h >> np.uint64(29))


def deletion_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (int64) of each text as it is (place -1) and without the code point at each place; the text's number, the place."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    own, at = np.repeat(np.arange(len(texts)), size), np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
    up, down = _tables(int(size.max(initial=0)) + 2)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_mixed((points + np.uint64(1)) * ODD[2]) * up[at], out=sums[1:])
    whole = sums[end] - sums[end - size]
    before = sums[:-1] - sums[end - size][own]
    after = (whole[own] - (sums[1:] - sums[end - size][own])) * down[1]  # one place further on
    h, n = np.r_[whole, before + after], np.r_[size, size[own] - 1].astype(np.uint64)
    return _mixed(h + n * ODD[3]).view(np.int64), np.r_[np.arange(len(texts)), own], np.r_[np.full(len(texts), -1), at].astype(np.int32)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about STEP code points."""
    size = pc.utf8_length(batch.column(0)).to_numpy()
    part = np.cumsum(size) // STEP
    edges = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            key, own, at = deletion_keys(part.column(0).to_pylist())
            rows = pa.array(own)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(at), part.column(0).take(rows), part.column(1).take(rows)], ["key", "at", "word", "n"])


def _long_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            texts = part.column(0).to_pylist()
            key, own, at = deletion_keys(texts)
            ids = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            for i in range(0, len(key), STEP):
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + STEP]), pa.array(at[i : i + STEP]), ids.take(pa.array(own[i : i + STEP]))], ["key", "at", "id"])


def _best(rows: dict[str, int]) -> list[tuple[int, str]]:
    """The two best words: most frequent, then smallest."""
    return sorted((-n, w) for w, n in rows.items())[:2]


def stars(rows: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """word, its near words, the best one's count, the best one, from rows(place, word, n) that share a string without the code point at place (-1: are it)."""
    longer: dict[str, int] = {}
    places: dict[int, dict[str, int]] = defaultdict(dict)
    base = None
    for at, word, n in rows:
        if at < 0:
            base = word, n
        else:
            longer[word] = n
            places[at][word] = n
    if base and longer:
        n, w = _best(longer)[0]
        yield base[0], len(longer), -n, w
        for word in longer:
            yield word, 1, base[1], base[0]
    for same in places.values():
        if len(same) > 1:
            best = _best(same)
            for word in same:
                n, w = best[best[0][1] == word]
                yield word, len(same) - 1, -n, w


def _runs(table: pa.Table) -> pa.RecordBatch:
    """NEAR rows of whole runs of equal keys: one for each word as it is, and what its runs say."""
    key, at = table.column("key").to_numpy(), table.column("at").to_numpy()
    own = pa.array(np.flatnonzero(at < 0))
    words_, n = (table.column(c).take(own) for c in ("word", "n"))
    same = key[1:] == key[:-1]
    rows = pa.array(np.flatnonzero(np.r_[same, False] | np.r_[False, same]))
    meet: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
    for i, w, k in zip(at[rows.to_numpy()].tolist(), table.column("word").take(rows).to_pylist(), table.column("n").take(rows).to_pylist(), strict=True):
        meet[w if i < 0 else w[:i] + w[i + 1 :]].append((i, w, k))
    found = [x for group in meet.values() if len(group) > 1 for x in stars(group)]
    a, b, c, d = zip(*found, strict=True) if found else ((), (), (), ())
    k, none = len(own), len(found)
    columns = [
        pa.array(words_.to_pylist() + list(a), pa.string()), pa.array(n.to_pylist() + [None] * none, pa.int64()), pa.array([0] * k + list(b), pa.int64()),
        pa.array([None] * k + list(c), pa.int64()), pa.array([None] * k + list(d), pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["word", "n", "near", "other_n", "other"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key. A run that a batch may not end waits for the next one."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _runs(table.slice(0, cut))
            held = table.slice(cut).combine_chunks()
    if held is not None:
        yield _runs(held)


def _long(found: DataFrame) -> DataFrame:
    """NEAR rows of the links of words of LONG code points and more."""
    texts = stored(found.filter(F.length("word") >= LONG).withColumn("id", F.unhex(F.sha2("word", 256))), "long-words")
    if texts.isEmpty():
        return found.sparkSession.createDataFrame([], NEAR)
    keys = stored(texts.select("word").mapInArrow(_long_keys, "key long, at int, id binary"), "long-keys")
    cut, a, b = keys.filter("at >= 0"), F.col("id").alias("a"), F.col("id").alias("b")
    one_less = keys.filter("at < 0").select("key", a).join(cut.select("key", b).distinct(), "key").select("a", "b")
    replaced = cut.select("key", "at", a).join(cut.select("key", "at", b), ["key", "at"]).filter("a < b").select("a", "b")
    pairs = stored(one_less.unionByName(replaced).distinct(), "long-pairs")
    side = lambda c: texts.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    links = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.greatest(F.length("a_word"), F.length("b_word")) > LONG) & (F.levenshtein("a_word", "b_word", 1) == 1))
    to = lambda x, y: F.struct(F.col(f"{x}_word").alias("word"), F.lit(None).cast("long").alias("n"), F.lit(1).cast("long").alias("near"), F.col(f"{y}_n").alias("other_n"), F.col(f"{y}_word").alias("other"))
    return links.select(F.explode(F.array(to("a", "b"), to("b", "a"))).alias("r")).select("r.*")


def near(found: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n for the stored table found(word, n)."""
    spark = found.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    keys = found.filter(F.length("word") <= LONG).mapInArrow(_short_keys, "key long, at int, word string, n long")
    radix = F.floor(F.shiftrightunsigned("key", 48) * parts / (1 << 16)).cast("int")
    short = keys.repartitionById(parts, radix).sortWithinPartitions("key").mapInArrow(_near, NEAR)
    none = found.filter(F.length("word") > LONG).select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("other_n"), F.lit(None).cast("string").alias("other"))
    rows = short.unionByName(none).unionByName(_long(found))
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))))
    told = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best.alias("best"))
    often = -F.col("best.n") >= TIMES * F.col("n")
    return told.select("word", "n", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of the stored table links(word, form), by pointer doubling: counts at least double from form to form, so a few rounds do."""
    up = stored(links.select("word", F.col("form").alias("to")), "roots")
    while True:
        on = checked_broadcast(up.select(F.col("word").alias("to"), F.col("to").alias("next")))
        new = stored(up.join(on, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not new.filter("moved").isEmpty()
        forget(up)
        up = new
        if not moved:
            return up.select("word", F.col("to").alias("root"))


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs(doc_id, text)."""
    found = stored(words(docs), "words")
    told = stored(near(found), "near-words")
    ends = roots(told.filter("form is not null"))
    return told.join(checked_broadcast(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES, ORACLES = {"op11_spelling": op11_spelling}, {}
