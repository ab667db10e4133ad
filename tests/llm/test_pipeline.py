import corpus_pipeline
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from heatfield.llm import mixing


def test_pipeline_stage_by_stage(spark, tmp_path):
    body = " ".join(f"word{i}" for i in range(200))
    rows = [(1, body, "en", "a", 0), (2, body.upper(), "en", "a", 0), (3, body.replace("word7 ", "other "), "en", "b", 0), (4, None, "en", "b", 0), (5, "12 34", None, None, 0)]
    rows += [(10 + i, f"a short text about thing{i} and matter{i} of no great length{i}", "en", f"s{i % 3}", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    ids, docs = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert name == "sentencepiece" or docs.columns == df.columns
    all_ids = {r[0] for r in rows}
    assert ids["language_id"] == all_ids - {4, 5}
    assert ids["exact_dedup"] == all_ids - {2, 4, 5} and ids["near_dedup"] == all_ids - {2, 3, 4, 5}
    assert ids["sentencepiece"] == ids["mixing"] <= ids["near_dedup"]
    library = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert {r.doc_id for r in out} == ids["mixing"] and all(r.ids == library.encode(texts[r.doc_id]) for r in out)
    assert mixing.ROUNDS == 8


def test_no_unique_row_is_lost(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "bee"), (9, "cat"), (9, "bee"), (5, "dup"), (5, "dup"), (None, "dup"), (None, "owl"), (None, "owl"), (2, None), (3, "")]
    spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, docs.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(1, "bee"), (9, "cat"), (5, "dup"), (None, "owl")])
    assert docs.columns[-2:] == ["key", "node"]


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixing_weighs_the_language_found(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    english, french = ["the house and the road of the town", "a river with many old boats"], ["les maisons et la route de la ville", "une rivière avec des bateaux"]
    rows = [(i, f"{words[i % 2]} {i}", lang, "a", 0) for i in range(200) for words, lang in [(french, "fr") if i % 4 == 3 else (english, "en")]]
    # One says a wrong language, one none.
    rows = [(i, t, {7: "en", 8: None}.get(i, lang), s, n) for i, t, lang, s, n in rows]
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert found.dtypes == docs.dtypes
    assert {r.doc_id: r.lang for r in found.collect()} == {i: "fr" if i % 4 == 3 else "en" for i in range(200)}
    cells = {r.mix_lang: r.n for r in mixing.described(found).groupBy("mix_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert cells == {"en": 150, "fr": 50}
