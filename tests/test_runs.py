"""Ingestion, commits, marks and runs over landed documents, stopped at any place."""

import gzip
import json
import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_facts import landed, match_doc, replay, timeline_doc  # noqa: F401

from heatfield.operators import release as R
from heatfield.sources import files
from heatfield.streaming import ingest as I
from heatfield.streaming import runs as U
from heatfield.streaming.lease import Lease, OwnershipError


def test_ingestion_takes_each_match_once_and_a_release_is_whole(spark, landed, tmp_path):
    root, made = landed
    land, store, site = tmp_path / "land", str(tmp_path / "store"), str(tmp_path / "site")
    for kind in ("match", "timeline"):
        (land / kind).mkdir(parents=True)

    def put(n, *kinds):
        for kind in kinds:
            (land / kind / f"{n}.json").write_text((root / kind / f"{n}.json").read_text())

    def run():
        U.execute(spark, str(land), store, f"r{len(list(land.rglob('*.json')))}", U.Settings(patches=("14.3",)))
        seen = I.Store(spark, store)
        return sorted((r.key, r.status, r.reason) for t in (seen.matches, seen.open) for r in t.read().select("key", "status", "reason").collect() if r.status != "pending")

    put(0, "match", "timeline")
    put(1, "match")
    assert run() == [("EU_0", "done", None), ("EU_1", "error", "timeline_404")]
    put(1, "timeline")
    put(2, "match", "timeline")
    assert [r for r in run() if r[1] == "done"] == [("EU_0", "done", None), ("EU_1", "done", None), ("EU_2", "done", None)]
    tables = I.committed(I.Store(spark, store))
    fact, match, player = (tables[name] for name in ("fact_kill", "dim_match", "dim_participant"))
    assert fact.count() == sum(len(replay(*made[n])) for n in range(3))
    first = R.publish(fact, match, player, site, {"schema": 1})
    assert R.publish(fact.orderBy("event_ms"), match, player, site, {"schema": 1}) == first == R.current(spark, site)
    wide = R.table(spark, site, "kills_wide")
    assert wide.count() == fact.count() and wide.filter("cause = 0 and killer_player is null").isEmpty()
    with pytest.raises(ValueError, match="duplicate"):
        R.publish(fact.unionByName(fact), match, player, site, {"schema": 1})
    with pytest.raises(RuntimeError):
        R.publish(fact.filter("match_id <> 'EU_2'"), match, player, site, {"schema": 1}, guard=lambda: (_ for _ in ()).throw(RuntimeError()))
    assert R.current(spark, site) == first and R.verified(spark, site)["matches"] == 3
    R.register(spark, site)
    assert spark.sql("SELECT count(*) n, count(DISTINCT match_id) g, max(cell_of(x, y, 32)) c, danger(6, 3) d FROM kills_wide").first().d == 11 / 19

    # Any release by its id, and only that one is read; without an id there is no answer.
    asked = spark.sql(f"SELECT count(*) AS n FROM kills_wide_of('{first}')")
    assert asked.first().n == fact.count() and f"dataset_id#" in asked._jdf.queryExecution().toString() and first in asked._jdf.queryExecution().toString().split("PartitionFilters:")[1].split("]")[0]
    with pytest.raises(Exception, match="WRONG_NUM_ARGS"):
        spark.sql("SELECT * FROM kills_wide_of()").collect()
    assert spark.sql(f"SELECT match_id FROM matches_of('{first}')").count() == 3

    # The wide table as typed columns holds the same.
    R.export_columns(spark, site, str(tmp_path / "wire"))
    kinds = R.wire_kinds(wide.columns)
    for group in ("core", "extended"):
        back = spark.read.format("typed_columns").load(f"{tmp_path}/wire/{first}/{group}")
        own = [F.col(c).cast("long").alias(c) for c in back.columns]
        assert back.select(*own).exceptAll(wide.select(*own)).isEmpty() and back.count() == wide.count()
    assert set(R.CORE) <= set(kinds) and R.verified(spark, site)["bytes_per_row"] == R.bytes_per_row(wide.columns) == 54

    # New names, other labels, games without a kill, and a write that ends between two tables.
    stale = fact.withColumn("region", F.lit(1))
    assert R.publish(stale, match, player, site, {"schema": 1}) == first
    renamed = player.withColumn("display_name", F.concat("display_name", F.lit("x")))
    second = R.publish(fact, match, renamed, site, {"schema": 1})
    assert second != first and R.current(spark, site) == second
    real = R.latest_names
    R.latest_names = lambda *_: (_ for _ in ()).throw(RuntimeError("stopped"))
    try:
        with pytest.raises(RuntimeError, match="stopped"):
            R.publish(fact, match, player, site, {"schema": 2})
    finally:
        R.latest_names = real
    assert R.current(spark, site) == second
    third = R.publish(fact, match, player, site, {"schema": 2})
    assert R.verified(spark, site)["dataset_id"] == third != second
    empty = R.publish(fact.limit(0), match, player, site, {"schema": 1})
    assert R.verified(spark, site)["rows"] == 0 and R.table(spark, site, "dim_match", empty).count() == 3
    assert R.publish(fact, match, player, site, {"schema": 1}) == first == R.current(spark, site)
    with pytest.raises(FileExistsError):
        files.put(spark, f"{site}/manifest/{first}.json", "{}")


def test_watermarks(spark):
    marks = spark.createDataFrame([("a", 0, 10), ("b", 0, 10), ("c", 99, 120)], "player string, scanned_from long, scanned_to long")
    seen = spark.createDataFrame([("a", 20, True, 0), ("b", 20, True, 1), ("c", 130, True, 0), ("d", 5, False, 0)], "player string, scanned_to long, finished boolean, open int")
    assert {(r.player, r.scanned_from, r.scanned_to) for r in I.advanced(marks, seen, 50).collect()} == {("a", 0, 20), ("b", 0, 10), ("c", 50, 130)}
    nobody = spark.createDataFrame([("m", None)], "match_id string, player string")
    assert {tuple(r) for r in I.advanced(marks, seen, 50, nobody).collect()} == {tuple(r) for r in marks.collect()}


@pytest.fixture(scope="module")
def games(tmp_path_factory):
    """A folder with 24 games' documents."""
    root = tmp_path_factory.mktemp("games")
    for kind in ("match", "timeline"):
        (root / kind).mkdir()
    for n in range(24):
        rng = random.Random(n)
        (root / "match" / f"{n}.json").write_text(json.dumps(match_doc(n, rng)))
        (root / "timeline" / f"{n}.json").write_text(json.dumps(timeline_doc(n, rng)))
    return root


@pytest.fixture
def place(games, tmp_path, monkeypatch):
    """land(n, ...) lands games, history(...) a page; run(mode) runs. Targets are 5 and 9 new games."""
    monkeypatch.setattr(U, "MODES", {"smoke": 5, "small": 9, "full": None})
    land, store, count = tmp_path / "land", str(tmp_path / "store"), iter(range(1000))

    class Place:
        root = store

        def land(self, *ns, kinds=("match", "timeline")):
            for kind in kinds:
                (land / kind).mkdir(parents=True, exist_ok=True)
                for n in ns:
                    shutil.copy(games / kind / f"{n}.json", land / kind / f"{n}-{next(count)}.json")

        def history(self, player, ids, until, start=0, done=True, since=0):
            (land / "history").mkdir(parents=True, exist_ok=True)
            page = {"puuid": player, "region": "europe", "since": since, "until": until, "start": start, "ids": [f"EU_{i}" for i in ids], "done": done}
            (land / "history" / f"{player}-{next(count)}.json").write_text(json.dumps(page))

        def run(self, spark, mode, run=None, **more):
            settings = more.pop("settings", U.Settings(mode))
            got = U.execute(spark, str(land), store, run or f"run{next(count)}", settings, **more)
            return got["status"], got["stage"], got["new_games"]

        def done(self, spark):
            return I.Store(spark, store).matches.read().filter("status = 'done'").count()

    return Place()


def test_targets_count_a_runs_own_new_games(spark, place):
    assert place.run(spark, "smoke") == ("paused", "exhausted", 0)  # nothing ever landed
    place.land(*range(20))
    assert place.run(spark, "smoke") == ("succeeded", "complete", 5) and place.done(spark) == 5
    assert place.run(spark, "small") == ("succeeded", "complete", 9) and place.done(spark) == 14
    assert place.run(spark, "full") == ("succeeded", "complete", 6) and place.done(spark) == 20
    assert place.run(spark, "smoke") == ("paused", "exhausted", 0)
    place.land(20)
    assert place.run(spark, "full") == ("succeeded", "complete", 1) and place.done(spark) == 21
    assert place.run(spark, "full") == ("succeeded", "complete", 0)
    seen = U.snapshot(spark, place.root)
    assert seen["run"]["mode"] == "full" and seen["run"]["new_games"] == 0 and seen["dataset"] is None


def test_failed_candidates_use_up_no_quota_and_are_tried_again(spark, place):
    place.land(*range(5))
    place.land(5, 6, kinds=("match",))
    place.land(7, kinds=("timeline",))
    assert place.run(spark, "small") == ("paused", "retry_required", 5)
    assert {(r.key, r.reason) for r in I.Store(spark, place.root).open.read().collect() if r.status == "error"} == {("EU_5", "timeline_404"), ("EU_6", "timeline_404"), ("EU_7", "match_404")}
    assert place.run(spark, "full") == ("paused", "retry_required", 0)
    place.land(5, 6, kinds=("timeline",))
    place.land(7, kinds=("match",))
    assert place.run(spark, "full") == ("succeeded", "complete", 3)


def test_a_run_goes_on_with_its_quota_and_its_settings(spark, place, monkeypatch):
    place.land(*range(12))
    real, calls = I.ingest, []

    def once(*a, **k):
        calls.append(1)
        real(*a, **k)
        raise RuntimeError("the driver died")

    monkeypatch.setattr(I, "ingest", once)
    monkeypatch.setattr(U, "BATCH", 3)
    with pytest.raises(RuntimeError):
        place.run(spark, "smoke", "r")
    assert U.record(spark, place.root, "r")["status"] == "failed" and place.done(spark) == 3
    monkeypatch.setattr(I, "ingest", real)
    assert place.run(spark, "smoke", "r", settings=None) == ("succeeded", "complete", 5) and place.done(spark) == 5
    assert place.run(spark, "smoke", "r", settings=None) == ("succeeded", "complete", 5) and place.done(spark) == 5
    with pytest.raises(FileExistsError):
        U.frozen(spark, place.root, "r", U.Settings("small"))
    with pytest.raises(FileNotFoundError):
        place.run(spark, "smoke", "never", settings=None)


def test_a_stopped_run_publishes_what_is_there(spark, place, tmp_path, monkeypatch):
    site = str(tmp_path / "site")
    place.land(*range(8))
    monkeypatch.setattr(U, "BATCH", 3)
    publisher = U.released(spark, place.root, site, {"schema": 1})
    assert place.run(spark, "full", "r", publisher=publisher, stop=lambda: place.done(spark) >= 3) == ("paused", "interrupted", 3)
    assert R.verified(spark, site)["matches"] == 3 and U.snapshot(spark, place.root)["dataset"]["dataset_id"] == R.current(spark, site)
    assert place.run(spark, "full", "r", publisher=publisher) == ("succeeded", "complete", 8) and R.verified(spark, site)["matches"] == 8


def test_a_lost_lease_publishes_nothing(spark, place, tmp_path, monkeypatch):
    place.land(*range(4))
    site, real = str(tmp_path / "site"), I.ingest
    publisher = U.released(spark, place.root, site, {"schema": 1})

    def stolen(*a, **k):
        real(*a, **k)
        clock = Lease(spark, place.root, now=lambda: 1e12)
        clock.claim("thief")

    monkeypatch.setattr(I, "ingest", stolen)
    with pytest.raises(OwnershipError):
        place.run(spark, "full", "r", publisher=publisher)
    assert R._pointer(spark, site) is None and U.record(spark, place.root, "r")["status"] == "running"
    monkeypatch.setattr(I, "ingest", real)
    with pytest.raises(OwnershipError, match="thief is running"):
        place.run(spark, "full", "other")


def test_of_two_publishers_a_stale_one_cannot_move_the_pointer(spark, tmp_path):
    site = str(tmp_path / "site")
    R.point(spark, site, "v1-a")
    R.point(spark, site, "v1-b", 3)
    R.point(spark, site, "v1-c", 4)
    with pytest.raises(PermissionError, match="owner 4"):
        R.point(spark, site, "v1-b", 3)
    assert R.current(spark, site) == "v1-c"
    R.point(spark, site, "v1-d", 4)
    R.point(spark, site, "v1-d", 4)
    R.point(spark, site, "v1-e")
    assert R.current(spark, site) == "v1-e" and R._pointer(spark, site)[0] == 4_000_003


def test_marks_wait_for_every_page_and_every_match(spark, place):
    marks = lambda: {r.key: (r.scanned_from, r.scanned_to) for r in I.Store(spark, place.root).marks.read().collect()}
    place.land(0, 1, 2)
    place.land(3, kinds=("match",))
    place.history("a", [0, 1], 100, done=False)
    place.history("b", [2, 3], 100)
    place.run(spark, "full")
    assert marks() == {}  # a has no last page, a match of b is open
    place.history("a", [2], 100, start=2)
    place.run(spark, "full")
    assert marks() == {"europe#a": (0, 100)}
    place.land(3, kinds=("timeline",))
    place.history("a", [4], 200, start=1)  # the first page of this window has not come yet
    place.run(spark, "full")
    assert marks() == {"europe#a": (0, 100), "europe#b": (0, 100)}  # EU_4 has no documents, and is a's; b's are settled
    place.land(4)
    place.run(spark, "full")
    assert marks() == {"europe#a": (0, 100), "europe#b": (0, 100)}
    place.history("a", [3], 200)
    place.run(spark, "full")
    assert marks() == {"europe#a": (0, 200), "europe#b": (0, 100)}
    row = spark.createDataFrame([(0, 200), (60, 200), (None, None)], "f long, t long")
    assert [r[0] for r in row.select(I.since(F.col("f"), F.col("t"), 50)).collect()] == [200, 50, 50]
    U.compacted(spark, place.root, U.Settings())
    assert marks() == {"europe#a": (0, 200), "europe#b": (0, 100)} and I.Store(spark, place.root).pages.read().count() == 0 and I.Store(spark, place.root).docs.read().count() == 0


def test_a_crash_between_ids_and_marks_loses_no_id(spark, place, monkeypatch):
    place.land(0, 1)
    place.history("a", [0, 1], 100)
    real = I.Keyed.upsert
    for stop in ("docs", "open", "pages"):

        def upsert(self, rows, step, stop=stop):
            if self.root.endswith(f"/{stop}"):
                raise RuntimeError("stopped")
            real(self, rows, step)

        monkeypatch.setattr(I.Keyed, "upsert", upsert)
        with pytest.raises(Exception, match="stopped|foreach"):
            place.run(spark, "full", "r")
        monkeypatch.setattr(I.Keyed, "upsert", real)
        assert I.Store(spark, place.root).marks.read().isEmpty()
    assert place.run(spark, "full", "r") == ("succeeded", "complete", 2)
    assert I.Store(spark, place.root).marks.read().count() == 1


def test_rows_that_were_changed_are_never_taken_as_committed(spark, place, monkeypatch):
    place.land(0, 1)
    store, real = I.Store(spark, place.root), I.digests

    def spoiled(tables):  # what is read back differs from what was to be written
        if any("batch=" in f for f in tables["fact_kill"].inputFiles()):
            tables = tables | {"fact_kill": tables["fact_kill"].withColumn("x", F.when(F.col("match_id") == "EU_0", F.col("x") + 1).otherwise(F.col("x")))}
        return real(tables)

    monkeypatch.setattr(I, "digests", spoiled)
    with pytest.raises(I.IntegrityError, match="EU_0"):
        place.run(spark, "full")
    assert store.matches.read().isEmpty() and I.committed(store) is None
    monkeypatch.setattr(I, "digests", real)
    assert place.run(spark, "full") == ("succeeded", "complete", 2)
    tables = I.committed(store)
    files_ = [f.removeprefix("file://") for f in tables["fact_kill"].inputFiles() if "batch=" in f]
    assert tables["fact_kill"].groupBy("match_id").count().count() == 2  # the lost batch's rows are not there twice
    assert tables["fact_kill"].count() == tables["fact_kill"].dropDuplicates(["match_id", "frame_index", "event_index"]).count()
    step = store.matches.read().first().batch
    mine = next(f for f in files_ if f"batch={step}/" in f)
    data = bytearray(open(mine, "rb").read())
    data[len(data) // 3] ^= 1
    open(mine, "wb").write(bytes(data))
    with pytest.raises(Exception, match="not those that were committed|orrupt|rror"):
        R.publish(*(I.committed(store)[t] for t in I.TABLES), f"{place.root}/site", {})
    assert not files.exists(spark, f"{place.root}/site/current")


def test_settings_are_checked_by_key_and_type(spark, tmp_path):
    assert U.strict({"mode": "smoke", "patches": ["14.3"], "floor_ms": 5}).scope == "14.3"
    for bad in ({"mod": "full"}, {"mode": 3}, {"patches": "14.3"}, {"schema": "1"}, {"floor_ms": True}, {"mode": "huge"}):
        with pytest.raises(ValueError):
            U.strict(bad)
    path = f"{tmp_path}/settings.json"
    assert U.settings_file(spark, path) == U.Settings()
    files.replace(spark, path, '{"mode": "small"}')
    assert U.settings_file(spark, path).mode == "small"
    files.replace(spark, path, "[1]")
    with pytest.raises(ValueError, match="no table"):
        U.settings_file(spark, path)
    assert U.outcome(3, 1, 50) == ("paused", "retry_required") and U.outcome(3, 0, 50) == ("paused", "exhausted") and U.outcome(0, 0, None) == ("succeeded", "complete")


def test_gzipped_and_unreadable_documents(spark, place, tmp_path):
    place.land(0)
    land = tmp_path / "land"
    with gzip.open(land / "match" / "1.json.gz", "wt") as f:
        f.write(json.dumps(match_doc(1, random.Random(1))))
    (land / "match" / "bad.json").write_text("{")
    assert place.run(spark, "full") == ("paused", "retry_required", 1)
    assert spark.read.parquet(f"{place.root}/unreadable").select("file").first()[0].endswith("bad.json")
