import threading

import pytest
from pyspark.sql import functions as F

from heatfield.sources import files
from heatfield.streaming import state
from heatfield.streaming.lease import Lease, OwnershipError
from heatfield.streaming.state import Keyed


def rows(spark, *items):
    return spark.createDataFrame(list(items), "key string, v int")


def said(table, **more):
    return sorted(tuple(r) for r in table.read(**more).collect())


def test_files_are_created_once_and_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/a b/x"
    assert files.create(spark, path, "one") and not files.create(spark, path, "two") and files.read(spark, path) == "one"
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(files.create(spark, f"{tmp_path}/race", str(i)))) for i in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1
    files.replace(spark, path, "three")
    files.replace(spark, f"{tmp_path}/new", "é")
    assert files.read(spark, path) == "three" and files.read(spark, f"{tmp_path}/new") == "é"
    assert not files.put(spark, path, "three") and files.names(spark, f"{tmp_path}/a b") == ["x"] and files.names(spark, f"{tmp_path}/none") == []
    with pytest.raises(FileExistsError):
        files.put(spark, path, "four")


@pytest.mark.parametrize("most", [0, 1000])
def test_upserts_deletes_and_late_steps(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(state, "CHANGED", most)
    t = Keyed(spark, str(tmp_path), "t", "v int")
    assert said(t) == [] and not t.compact()
    t.upsert(rows(spark, ("a", 1), ("b", 1)), 1)
    t.upsert(rows(spark, ("b", 2), ("c", 2)), 2)
    t.upsert(rows(spark, ("b", 2), ("c", 2)), 2)
    t.delete(rows(spark, ("a", 0)).select("key"), 3)
    want = [("b", 2), ("c", 2)]
    assert said(t) == want and t.compact() and said(t) == want and t.deltas() == [] and not t.compact()
    t.upsert(rows(spark, ("a", 1), ("b", 1)), 1)  # a step that is written again, late: it brings nothing back
    assert said(t) == want and t.merged() == 3 and t.deltas() == []
    t.upsert(rows(spark, ("d", 1)), 4)
    assert said(t) == [*want, ("d", 1)] and said(t, prefix="c") == [("c", 2)] and said(t, keys=["b", "x", "d"]) == [("b", 2), ("d", 1)]
    assert not t.compact(least=1) and t.compact(lambda df: df.filter("v > 1")) and said(t) == want
    with pytest.raises(ValueError):
        t.read(keys=["k"] * 5000)


def test_a_prefix_reads_only_the_ranges_that_may_hold_it(spark, tmp_path):
    t = Keyed(spark, str(tmp_path), "t", "v int")
    t.upsert(spark.range(0, 4000, numPartitions=4).select(F.concat(F.lit("r"), (F.col("id") % 4).cast("string"), F.lit("#"), F.col("id").cast("string")).alias("key"), F.col("id").cast("int").alias("v")), 1)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t.compact()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    every, some, one = t.read(), t.read(prefix="r2#"), t.read(keys=["r3#7"])
    assert some.count() == 1000 and one.collect()[0].v == 7

    def read(df):
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        scan = plan.collectLeaves().apply(0)
        return scan.metrics().apply("numFiles").value()

    assert read(every) == 4 and read(some) < 4 and read(one) <= 2
    assert "PartitionFilters: [isnotnull(part" in some._jdf.queryExecution().toString() or "PartitionFilters: [part" in some._jdf.queryExecution().toString()


def test_a_stop_while_compacting_loses_nothing(spark, tmp_path, monkeypatch):
    t = Keyed(spark, str(tmp_path), "t", "v int")
    t.upsert(rows(spark, ("a", 1), ("b", 1)), 1)
    real, switch = files.create, Keyed._switch
    monkeypatch.setattr(Keyed, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("before the switch")))
    with pytest.raises(RuntimeError):
        t.compact(lambda df: df.filter("key = 'a'"))
    assert said(t) == [("a", 1), ("b", 1)]
    monkeypatch.setattr(Keyed, "_switch", switch)
    monkeypatch.setattr(files, "delete", lambda *_: (_ for _ in ()).throw(RuntimeError("before the deletion")))
    with pytest.raises(RuntimeError):
        t.compact(lambda df: df.filter("key = 'a'"))
    monkeypatch.undo()
    assert files.create is real and said(t) == [("a", 1)] and len([n for n in files.names(spark, t.root) if n.startswith("gen")]) == 2
    t.upsert(rows(spark, ("c", 1)), 9)
    assert t.compact() and said(t) == [("a", 1), ("c", 1)] and len([n for n in files.names(spark, t.root) if n.startswith("gen")]) == 1
    broken = f"{t._at(t.generation())}/delta/{7:018d}"
    rows(spark, ("x", 1)).selectExpr("*", "7L as _step", "false as _gone").write.parquet(broken)
    files.delete(spark, f"{broken}/_SUCCESS")  # a write that never committed
    assert said(t) == [("a", 1), ("c", 1)]


def test_one_owner_at_a_time(spark, tmp_path):
    clock = [1000.0]
    lease = lambda: Lease(spark, str(tmp_path), 60, lambda: clock[0])
    one, two = lease(), lease()
    with pytest.raises(OwnershipError):
        one.check()
    first = one.claim("one")
    with pytest.raises(OwnershipError, match="one is running"):
        two.claim("two")
    clock[0] += 50
    one.beat()
    clock[0] += 50
    one.check()
    with pytest.raises(OwnershipError):
        two.claim("two")
    steps = [one.step(), one.step()]
    clock[0] += 61  # the owner sleeps too long
    assert two.claim("two") > first and two.step() > steps[1] > steps[0]
    for late in (one.check, one.beat):
        with pytest.raises(OwnershipError):
            late()
    one.release()
    two.check()
    two.release()
    assert lease().claim("three") == first + 2


def test_beats_in_the_background_keep_the_lease(spark, tmp_path):
    import time

    one, two = Lease(spark, str(tmp_path), 1.5), Lease(spark, str(tmp_path), 1.5)
    one.claim("one")
    one.keep(0.2)
    time.sleep(2.5)
    one.check()
    with pytest.raises(OwnershipError):
        two.claim("two")
    one.release()
    two.claim("two")
    two.release()


def test_a_task_merges_a_bounded_number_of_rows(spark, tmp_path):
    state = Keyed(spark, str(tmp_path), "few", "v long", each=10)
    state.upsert(spark.range(95).selectExpr("cast(id as string) as key", "id as v"), 1)
    rows = state.rows()
    assert rows.rdd.getNumPartitions() == 10 and {r.v for r in rows.collect()} == set(range(95))
