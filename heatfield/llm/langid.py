"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram (orders 1 to 3 of the lower-cased text) of every training text into 2**BITS buckets a
language: a task adds its texts up in numpy, Spark adds the tasks up. The log-probability matrix has
languages x 2**BITS floats whatever the size of the corpus and is broadcast; texts are scored in Arrow batches, each as
the sum of the matrix rows of its n-grams, in pieces of PIECE characters so that a very long text needs no more memory.

Defined results: a null text, or one without a letter, is `und` with score 0; without any training text all are `und`;
a null doc_id is not held out; ties go to the language that sorts first; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.llm.common import small_batches

BITS, PIECE, ALPHA = 15, 1 << 18, 0.1
#: Numbers of the matrix that are gathered at once, about.
GATHERED = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(0x9E3779B1)


def buckets(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all 1-, 2- and 3-grams of a text, piece by piece."""
    text = f" {text.lower()} "
    for at in range(0, max(1, len(text) - 2), PIECE):
        last = at + PIECE >= len(text) - 2
        c = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        two = c[:-1] * _MIX + c[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * _MIX + c[2:]
        grams = (c if last else c[:-2], (two if last else two[:-1]) + np.uint32(0x51ED270B), three + np.uint32(0x2545F491))
        g = np.concatenate(grams)
        g = (g ^ (g >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        yield (g ^ (g >> np.uint32(13))) >> np.uint32(32 - BITS)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = sums.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            mine[-1] += 1
            for b in buckets(text):
                mine[:-1] += np.bincount(b, minlength=1 << BITS)
    for lang, mine in sums.items():
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(mine[at])], ["lang", "bucket", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities [bucket, language] and log-priors, from all rows of labelled(text, lang) with both."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    counts = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most languages x (2**BITS + 1) rows
    found = table.column("lang").to_numpy(zero_copy_only=False)
    langs = sorted(set(found))
    sums = np.zeros(((1 << BITS) + 1, max(1, len(langs))))
    sums[table.column("bucket").to_numpy(), [langs.index(x) for x in found]] = table.column("n").to_numpy()
    grams, docs = sums[:-1] + ALPHA, np.maximum(sums[-1], 1)
    return langs, np.log(grams / grams.sum(axis=0)).astype(np.float32), np.log(docs / docs.sum())


Model = tuple[list[str], np.ndarray, np.ndarray]


def scored(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """Languages and scores of texts. Rows of the matrix are gathered for the n-grams of many texts at once and summed by text.

    The score is the winner's share after the log-odds are divided by the root of the number of n-grams, so that it stays a grade
    and does not saturate.
    """
    langs, logp, prior = model
    known = [i for i, t in enumerate(texts) if langs and t is not None and _LETTER.search(t)]
    total, n = np.tile(prior.astype(np.float64), (len(texts), 1)), np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[int] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(b) for b in held])
            sums = np.add.reduceat(logp[np.concatenate(held)], np.cumsum(sizes) - sizes, axis=0, dtype=np.float64)
            np.add.at(total, owner, sums)
            np.add.at(n, owner, sizes)
            held.clear()
            owner.clear()

    room, most = 0, max(1, GATHERED // max(1, len(langs)))
    for i in known:
        for b in buckets(texts[i]):
            held.append(b)
            owner.append(i)
            room += len(b)
            if room > most:
                flush()
                room = 0
    flush()
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if known:
        mine = total[known]
        best = mine.argmax(axis=1)
        share = 1 / np.exp((mine - mine.max(axis=1, keepdims=True)) / np.sqrt(n[known])[:, None]).sum(axis=1)
        for i, k, x in zip(known, best.tolist(), share.tolist(), strict=True):
            names[i], scores[i] = langs[k], x
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def held_out():
    """Whether crc32 of the document's number as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the labelled documents that are not held out."""
    found = predict(docs, train(docs.filter(~held_out()).select("text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_identified(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, whose text has a language: those that identify() calls `und` or scores below `least` go, and lang is the language found, also where a label said another or none.

    Predictions are made beside the row's own columns, so no join and no shuffle of texts is needed.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs.filter(~held_out()).select("text", "lang")))
    docs = docs.withColumn("lang", F.col("lang").cast("string"))
    at, to = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = scored(batch.column(at).to_pylist(), shared.value)
            own = pa.array([lang != "und" and score >= least for lang, score in zip(names, scores, strict=True)], pa.bool_())
            yield batch.set_column(to, batch.schema.field(to), pa.array(names, batch.schema.field(to).type)).filter(own)

    return docs.mapInArrow(keep, docs.schema)


QUERIES, ORACLES = {"op7_language_id": op7_language_id}, {}
