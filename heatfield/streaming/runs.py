"""Runs of the collector over landed documents: one at a time, with frozen settings, targets of new games and a record.

A run discovers what has landed, then takes candidates in its own pseudo-random order, in batches of no more than its
target still lacks, until it has the target or nothing is left. What counts are games that this run committed, also before an
earlier end. Then players' marks move and a release is published. A run that is stopped publishes what is there and is paused;
one that loses its lease publishes nothing and leaves everything to the new owner.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any, get_type_hints

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.operators import collection as C
from heatfield.operators import release as R
from heatfield.sources import files
from heatfield.streaming import ingest as I
from heatfield.streaming.lease import HOLD, Lease, OwnershipError

#: New games that a run of a mode takes.
MODES = {"smoke": 50, "small": 250, "full": None}
#: Most candidates of a batch where a run has no target.
BATCH = 100_000
#: Most names that are broadcast.
NAMES = 100_000
#: What a run's record shows.
PUBLIC = ("run_id", "mode", "status", "stage", "new_games", "target", "started_at", "updated_at", "published_version", "discovered_games", "players", "scanned_players", "error")


class Paused(RuntimeError):
    """The run was asked to stop."""


@dataclass(frozen=True)
class Settings:
    mode: str = "full"
    patches: tuple[str, ...] = ()
    schema: int = 1
    floor_ms: int = 0

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"unknown mode {self.mode}")
        object.__setattr__(self, "patches", tuple(self.patches))

    @property
    def scope(self) -> str:
        return I.scope_of(list(self.patches))


def strict(raw: Mapping[str, Any]) -> Settings:
    """Settings from a plain table; a key that is not known and a value of another type are errors."""
    known = get_type_hints(Settings)
    if unknown := set(raw) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    for key, value in raw.items():
        kind = known[key]
        listed = not isinstance(kind, type)
        good = isinstance(value, (list, tuple)) and all(isinstance(x, str) for x in value) if listed else isinstance(value, kind) and not isinstance(value, bool)
        if not good:
            raise ValueError(f"{key} cannot be {value!r}")
    return Settings(**raw)


def settings_file(spark: SparkSession, path: str) -> Settings:
    """Settings from a JSON file; no file gives the defaults."""
    if not files.exists(spark, path):
        return Settings()
    raw = json.loads(files.read(spark, path))
    if not isinstance(raw, dict):
        raise ValueError(f"{path} holds no table of settings")
    return strict(raw)


def frozen(spark: SparkSession, root: str, run: str, settings: Settings | None = None) -> Settings:
    """The run's settings: those it began with, which nobody may change."""
    path = f"{root}/runs/{run}.json"
    if settings is not None:
        files.put(spark, path, json.dumps(asdict(settings), sort_keys=True))
        return settings
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no run {run}")
    return strict(json.loads(files.read(spark, path)))


def record(spark: SparkSession, root: str, run: str) -> dict | None:
    """The run's record as it was last written."""
    path = f"{root}/runs/{run}.state.json"
    return json.loads(files.read(spark, path)) if files.exists(spark, path) else None


def snapshot(spark: SparkSession, root: str) -> dict:
    """What the latest run shows, and the release that is published."""
    read = lambda name: files.read(spark, f"{root}/{name}") if files.exists(spark, f"{root}/{name}") else None
    run, published = read("runs/latest"), read("runs/published")
    saved = record(spark, root, run) if run else None
    return {"run": {k: saved[k] for k in PUBLIC if k in saved} if saved else None, "dataset": json.loads(published) if published else None}


def outcome(new: int, errors: int, target: int | None) -> tuple[str, str]:
    """Status and stage of a run that came to its end."""
    if target is not None and new < target:
        return "paused", "retry_required" if errors else "exhausted"
    return ("paused", "retry_required") if target is None and errors else ("succeeded", "complete")


class Run:
    """One run; execute() makes and drives it."""

    def __init__(self, spark: SparkSession, root: str, run: str, settings: Settings, lease: Lease, stop: Callable[[], bool], saved: dict | None):
        self.spark, self.root, self.run, self.settings, self.lease, self.stop = spark, root, run, settings, lease, stop
        self.store, self.target = I.Store(spark, root), MODES[settings.mode]
        self.record = saved or {"run_id": run, "mode": settings.mode, "target": self.target, "new_games": 0, "started_at": int(time.time())}

    def patch(self, **values: Any) -> None:
        self.lease.check()
        self.record |= values | {"updated_at": int(time.time())}
        files.replace(self.spark, f"{self.root}/runs/{self.run}.state.json", json.dumps(self.record))

    def check(self) -> None:
        self.lease.check()
        if self.stop():
            raise Paused("the run was stopped")

    def candidates(self) -> DataFrame:
        return self.store.candidates(self.settings.schema, self.settings.scope)

    def discover(self, landed: str) -> None:
        self.patch(status="running", stage="discovering")
        if query := I.stream(self.store, landed, self.lease, self.settings.schema, self.settings.scope):
            query.awaitTermination()
        seen = I.histories(self.store.pages.read()).agg(F.count_distinct("player").alias("n"), F.count_distinct(F.when(F.col("finished"), F.col("player"))).alias("read")).first()
        self.patch(discovered_games=self.candidates().count(), players=seen.n, scanned_players=seen.read)

    def collect(self) -> None:
        """Each candidate at most once, in the run's order."""
        self.patch(stage="collecting", new_games=self.store.new_games(self.run))
        last = ""
        while self.target is None or self.record["new_games"] < self.target:
            self.check()
            want = BATCH if self.target is None else min(BATCH, self.target - self.record["new_games"])
            step, path = self.lease.step(), f"{self.root}/work/chosen"
            C.shuffled(self.candidates(), "match_id", self.run).filter(F.col("order") > last).orderBy("order").limit(want).write.mode("overwrite").parquet(path)
            chosen = self.spark.read.schema("match_id string, player string, status string, order string").parquet(path)
            last = chosen.agg(F.max("order")).first()[0]
            if last is None:
                break
            I.ingest(self.store, chosen, step, self.run, list(self.settings.patches) or None, self.settings.schema)
            self.patch(new_games=self.store.new_games(self.run))
            self.store.tidy(self.settings.schema, self.settings.scope)

    def publish(self, publisher: Callable[[Callable[[], None], int], str] | None, check: Callable[[], None]) -> None:
        """A release of everything that is committed, if there is anything."""
        if publisher is None or self.store.matches.read().filter("status = 'done'").isEmpty():
            return
        self.patch(stage="publishing")
        name = publisher(check, self.lease.number)
        check()
        files.replace(self.spark, f"{self.root}/runs/published", json.dumps({"dataset_id": name, "run_id": self.run}))
        self.patch(published_version=name)

    def salvage(self, publisher: Callable[[Callable[[], None], int], str] | None) -> None:
        """Publishes what is there before the run is paused; only a lost lease goes on as an error."""
        try:
            self.publish(publisher, self.lease.check)
        except OwnershipError:
            raise
        except Exception as e:
            self.patch(error=f"not published: {type(e).__name__}")
        self.patch(status="paused", stage="interrupted")


def execute(spark: SparkSession, landed: str, root: str, run: str, settings: Settings | None = None, publisher: Callable[[Callable[[], None], int], str] | None = None, stop: Callable[[], bool] = lambda: False, hold: float = HOLD) -> dict:
    """Runs or goes on with a run and returns its record. publisher(guard, fence) publishes, see released(). An OwnershipError if another run is on."""
    saved = record(spark, root, run)
    if saved and saved.get("status") == "succeeded":
        return saved
    mine, lease = frozen(spark, root, run, settings), Lease(spark, root, hold)
    lease.claim(run)
    lease.keep(hold / 6)
    one = Run(spark, root, run, mine, lease, stop, saved)
    try:
        files.replace(spark, f"{root}/runs/latest", run)
        one.discover(landed)
        one.collect()
        one.check()
        I.advance(one.store, lease.step(), mine.floor_ms, mine.schema, mine.scope)
        one.publish(publisher, one.check)
        status, stage = outcome(one.record["new_games"], one.candidates().filter("status = 'error'").count(), one.target)
        one.patch(status=status, stage=stage)
    except Paused:
        one.salvage(publisher)
    except OwnershipError:
        raise  # what there is now belongs to another owner
    except Exception as e:
        one.patch(status="failed", error=type(e).__name__)
        raise
    finally:
        lease.release()
    return one.record


def released(spark: SparkSession, root: str, site: str, versions: dict) -> Callable[[Callable[[], None], int], str]:
    """A publisher of the committed matches to site; the fence keeps an owner that has lost its lease from moving the pointer."""

    def publish(guard: Callable[[], None], fence: int) -> str:
        tables = I.committed(I.Store(spark, root))
        return R.publish(*(tables[name] for name in ("fact_kill", "dim_match", "dim_participant")), site, versions, guard, fence)

    return publish


def compacted(spark: SparkSession, root: str, settings: Settings, owner: str = "compaction") -> None:
    """Writes all state anew without what is settled; rows are deleted only after they were written."""
    lease = Lease(spark, root)
    lease.claim(owner)
    try:
        I.Store(spark, root).tidy(settings.schema, settings.scope, 0)
    finally:
        lease.release()


def named(df: DataFrame, names: DataFrame | None, key: str, to: str) -> DataFrame:
    """df with the name of `key` from names(key, name); the key itself as text where there is no table or no name."""
    own = F.col(key).cast("string")
    if names is None:
        return df.withColumn(to, own)
    table = names.select(F.col("key").cast(df.schema[key].dataType).alias(key), F.col("name").alias(to))
    table = F.broadcast(table) if table.limit(NAMES + 1).count() <= NAMES else table
    return df.join(table, key, "left").withColumn(to, F.coalesce(to, own))


def champion_names(spark: SparkSession, path: str) -> DataFrame | None:
    """key, name of a dictionary {"data": {...: {"key": "1", "name": "..."}}}, or None where there is none."""
    if not files.exists(spark, path):
        return None
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "data map<string, struct<key:string, name:string>>").alias("v"))
    return text.select(F.explode(F.map_values("v.data")).alias("x")).select(F.col("x.key").try_cast("int").alias("key"), F.col("x.name").alias("name")).filter("key is not null")
