from pyspark.sql import functions as F

from heatfield.operators import collection as C


def test_report_and_backlog(spark):
    rows = spark.createDataFrame([(f"m{i % 7}", i) for i in range(13)], "match_id string, seq int")
    done = spark.createDataFrame([(f"m{i}",) for i in range(6)], "match_id string")
    assert tuple(C.dedupe_report(rows, done).first()) == (13, 7, 6, 6, 1)
    assert [tuple(r) for r in C.backlog(rows, done, "seq").collect()] == [("m6", 6)]
    assert tuple(C.dedupe_report(rows.limit(0), done).first()) == (0, 0, 0, 0, 0)


def test_settled_scope_quota_and_headers(spark):
    records = spark.createDataFrame([("a", "done", 1, None), ("b", "rejected", 1, "14.3"), ("c", "rejected", 1, "14.2"), ("d", "error", 1, None), ("e", "done", 0, None)], "match_id string, status string, schema int, scope string")
    assert {r[0] for r in C.settled(records, 1, "14.3").collect()} == {"a", "b"}
    rows = spark.range(100).withColumn("ok", F.col("id") % 2 == 0)
    one, two = ([r.id for r in C.quota(rows.orderBy(F.rand()), 10, "id", "r", F.col("ok")).collect()] for _ in range(2))
    assert one == two and len(one) == 10 and all(i % 2 == 0 for i in one)
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(C.pairs(F.lit("20:1,100:120"))) == {1: 20, 120: 100} and one(C.pairs(F.lit(" 20:1 ,, x:3,5,7:1:2,30:1"))) == {1: 30}
    assert one(C.pairs(F.lit(None).cast("string"))) == {} == one(C.pairs(F.lit("")))
    assert [one(C.region_of(F.lit(x))) for x in ("EUW1_5", "KR_1", "ZZ_1")] == ["europe", "asia", None]
    assert spark.range(1).select(C.platform_of(F.lit("EUW1_5"))).first()[0] == "euw1"
    ladder = spark.createDataFrame([("x", "B", 1), ("x", "A", 2), ("y", "B", 3)], "puuid string, tier string, lp int")
    assert {tuple(r) for r in C.first_tier(ladder, ["A", "B"]).collect()} == {("x", "A", 2), ("y", "B", 3)}
