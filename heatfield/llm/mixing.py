"""Mixing to target weights by iterative proportional fitting.

Documents are added up to cells (source, language, topic) of tokens. Raking scales the cells' weights in turn so that
their sums meet the target share of every source, every language and every topic; ROUNDS rounds over the cell table,
whose size depends on the categories and not on the documents. One task holds the cells of one category at a time, and
all of them twice; more than CELLS are an error. A document is then sampled with the probability of its
cell, the ratio of raked to present tokens over the largest such ratio, by a draw that its doc_id fixes.

Targets default to the present shares to the power of TEMPERATURE, which lifts small categories. Documents carry no
topic; topic() sorts them by form (table, noisy, short, medium, long).

Defined results: null categories are the category ''; null and empty texts have no tokens, are cells of weight 0 where
they are alone, and are kept with probability 1; a null doc_id draws as an empty string; repeated rows draw alike;
other columns are not read by the query and are kept by sample().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatfield.llm.common import checked_broadcast, stored

ROUNDS, TEMPERATURE, SEED, CELLS = 8, 0.7, "mix-1", 5_000_000
DIMS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == 0, 0).otherwise(F.size(F.split(t, " "))).cast("long")


def topic(text: Column, n: Column) -> Column:
    return F.when(F.contains(text, F.lit(" | ")), "table").when(F.contains(text, F.lit("###")), "noisy").when(n < 200, "short").when(n < 1000, "medium").otherwise("long")


def described(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, whatever their names), mix_source, mix_lang, mix_topic and mix_tokens."""
    n = n_tokens(F.col("text"))
    cat = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), cat("source").alias("mix_source"), cat("lang").alias("mix_lang"), n.alias("mix_tokens"), topic(F.coalesce("text", F.lit("")), n).alias("mix_topic"))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens) with p, the sampling probability. targets: for each dimension a table (dimension, share)."""
    if cells.limit(CELLS + 1).count() > CELLS:
        raise ValueError(f"more than {CELLS} cells of {DIMS}")
    all_rows, w = Window.partitionBy(), cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMS:
        if targets and d in targets:
            w = w.join(targets[d].select(d, F.col("share").alias(f"t_{d}")), d, "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)))
        else:
            shares = cells.groupBy(d).agg(F.sum("tokens").cast("double").alias("n")).select(d, F.pow("n", F.lit(TEMPERATURE)).alias("n"))
            w = w.join(shares.select(d, (F.col("n") / F.sum("n").over(all_rows)).alias(f"t_{d}")), d)
    w = stored(w, "cells")
    for k in range(rounds):
        for d in DIMS:
            total = F.sum("w").over(Window.partitionBy(d))
            w = w.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"t_{d}") / total).otherwise(F.lit(0.0)))
        if k % 4 == 3:
            w = stored(w, "cells")
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    w = stored(w.withColumn("ratio", ratio), "cells")
    return stored(w.select(*DIMS, "tokens", F.coalesce(F.col("ratio") / F.max("ratio").over(all_rows), F.lit(1.0)).alias("p")), "mix")


def draw() -> Column:
    """A number from 0 to 1 that doc_id fixes."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def weighed(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """described(docs) with mix_p and sampled."""
    rows = described(docs)
    cells = stored(rows.groupBy(*[F.col(f"mix_{d}").alias(d) for d in DIMS]).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    mix = checked_broadcast(rake(cells, targets).select(*[F.col(d).alias(f"mix_{d}") for d in DIMS], F.col("p").alias("mix_p")))
    return rows.join(mix, [f"mix_{d}" for d in DIMS]).withColumn("sampled", draw() < F.col("mix_p"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of docs, with the columns of docs."""
    return weighed(docs, targets).filter("sampled").select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return weighed(docs).select("row.doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_p", 6).alias("p"), "sampled")


def _sql() -> str:
    """The same as one statement: a common table expression for each step of the raking."""
    n = "CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE len(string_split(text, ' ')) END"
    out = [f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST({n} AS BIGINT) AS n_tokens FROM documents),
d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '###') THEN 'noisy' WHEN n_tokens < 200 THEN 'short' WHEN n_tokens < 1000 THEN 'medium' ELSE 'long' END AS topic FROM a),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL)"""]
    for d in DIMS:
        out.append(f"s_{d} AS (SELECT {d}, v / sum(v) OVER () AS t_{d} FROM (SELECT {d}, pow(sum(tokens), {TEMPERATURE}) AS v FROM c GROUP BY {d}))")
    out.append("w0 AS MATERIALIZED (SELECT c.*, tokens AS w, t_source, t_lang, t_topic FROM c JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic))")
    for k in range(ROUNDS * 3):
        d = DIMS[k % 3]
        out.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w) FROM w{k})")
    out.append(f"r AS (SELECT source, lang, topic, coalesce((CASE WHEN tokens > 0 THEN w / tokens END) / max(CASE WHEN tokens > 0 THEN w / tokens END) OVER (), 1.0) AS p FROM w{ROUNDS * 3})")
    u = f"CAST(('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0"
    return ",\n".join(out) + f"\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS p, {u} < p AS sampled FROM d JOIN r USING (source, lang, topic)"


QUERIES, ORACLES = {"op4_mixing": op4_mixing}, {"op4_mixing": _sql()}
