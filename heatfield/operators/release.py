"""Releases: relabelled zones, integrity, dense keys, the wide table, a content digest, a manifest and a pointer.

A release is six tables under root/<table>/dataset_id=<id>. Its id is a digest of facts, dimensions and versions, so the
same content is the same release, and new names or games without a kill make a new one. The tables are written first, and
what they hold is observed as they are written: no table is read again to be counted. Then come a validation report and
the manifest, which is the release's mark of completeness: without it a release is written anew. The pointer is a
file of a new number each time, created once; the one with the greatest number counts, so there is always one.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from heatfield.functions import geometry as G
from heatfield.operators import facets as H
from heatfield.operators.asof import dealt
from heatfield.operators.facts import KINDS
from heatfield.sources import columns as typed_columns
from heatfield.sources import files

IDENTITY = ("match_id", "frame_index", "event_index")
TABLES = ("fact_kill", "dim_match", "dim_participant", "kills_wide", "matches", "players")
#: The most players and patches that their keys' wire types hold.
MOST_PLAYERS, MOST_PATCHES = 65_534, 254


def duplicates(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(fact: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    return fact.join(dim, on, "left_anti")


def count_report(df: DataFrame, key: str, when: Column, over: str) -> DataFrame:
    """One row: rows, rows beyond the distinct keys, rows for which `when` holds, least and greatest of `over`."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeats"), F.count_if(when).alias("matching"), F.min(over).alias("first"), F.max(over).alias("last"))


def dense_keys(dim: DataFrame, key: str, sk: str, most: int = MOST_PLAYERS) -> DataFrame:
    """Keys from 0 in order of a small dimension's values, by one window; more than `most` values are an error."""
    values = dim.select(key).distinct()
    if values.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} values of {key}")
    return values.withColumn(sk, (F.row_number().over(Window.orderBy(key)) - 1).cast("int"))


def ranged_keys(dim: DataFrame, key: str, sk: str, path: str) -> DataFrame:
    """Keys from 0 in order of a dimension's values, of any number of them: the values are dealt by range and stored under path, and a range's keys begin behind those of the ranges before it."""
    spark, n = dim.sparkSession, dim.count()
    values = dealt(dim.select(key), n, ROWS, key).distinct()
    ranged(values, n, key).withColumn("at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    # The upper bits of `at` are the range, the lower ones the place in it.
    placed = spark.read.schema(f"{key} {values.schema[key].dataType.simpleString()}, at long").parquet(path).select(key, F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(before), "range").select(key, (F.col("before") + F.col("place")).alias(sk))


def latest_names(players: DataFrame) -> DataFrame:
    """puuid and the name of its last match, matches ordered as text. Rows are dealt by match, so that a task sorts about ROWS of them before only a row a player is left."""
    return dealt(players, players.count(), ROWS, "match_id").groupBy("puuid").agg(F.max_by("display_name", "match_id").alias("display_name"))


#: Rows of a task that joins facts with a large table, or sorts a table, and rows of a table that goes to all tasks instead.
ROWS, SMALL = 200_000, 100_000


def ranged(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n rows of df in ranges of the first of order, of about ROWS rows each, sorted."""
    return df.repartitionByRange(max(1, -(-n // ROWS)), order[0]).sortWithinPartitions(*order)


def denormalised(fact: DataFrame, keys: dict[str, tuple[str, DataFrame, str]], rows: int | None = None) -> DataFrame:
    """fact with the columns of keys[name] = (column of fact, table of one row a value, inner or left): each table's first column is the value,
    the others are added. A value that comes twice in a table, or is not in an inner one, is an error of the job that uses the rows,
    so the joins run once and cannot change the number of rows.

    rows is how many fact has; without it they are counted. A table of at most SMALL rows is broadcast; for another, both sides are
    dealt by the value in as many partitions as there are ROWS of facts."""
    out, n = fact, rows
    for name, (column, table, how) in keys.items():
        key, *own = table.columns
        small = table.limit(SMALL + 1).count() <= SMALL
        if not small:
            n = fact.count() if n is None else n
            out, table = dealt(out, n, ROWS, column), dealt(table, n, ROWS, key)
        one = table.groupBy(F.col(key).alias(column)).agg(F.first(F.struct(*own)).alias("_own"), F.count(F.lit(1)).alias("_n"))
        fault = lambda what, name=name: F.raise_error(F.lit(f"the joins would change the number of rows: {what} in {name}"))
        sound = F.when(F.col("_n") > 1, fault("a value twice"))
        sound = sound.when(F.col("_n").isNull(), fault("a value missing")) if how == "inner" else sound
        out = out.join(F.broadcast(one) if small else one, column, "left").withColumn("_own", sound.otherwise(F.col("_own"))).select(*out.columns, "_own.*")
    return out


def wide(fact: DataFrame, dim_match: DataFrame, dim_player: DataFrame, work: str, rows: int | None = None) -> DataFrame:
    """Facts, of which there are `rows`, with keys of match, patch and players."""
    n = dim_match.count()
    match = dealt(ranged_keys(dim_match, "match_id", "match", f"{work}/match_keys"), n, ROWS, "match_id").join(dealt(dim_match.select("match_id", "patch_id"), n, ROWS, "match_id"), "match_id")
    match = match.join(F.broadcast(dense_keys(dim_match, "patch_id", "patch", MOST_PATCHES)), "patch_id").select("match_id", "match", "patch")
    player = dense_keys(dim_player, "puuid", "player")
    side = lambda who: player.select("puuid", F.col("player").alias(f"{who}_player"))
    return denormalised(fact, {"match": ("match_id", match, "inner"), "victim": ("victim_player_id", side("victim"), "inner"), "killer": ("killer_player_id", side("killer"), "left")}, rows)


def relabelled(fact: DataFrame) -> DataFrame:
    """Facts with the zones of today's map."""
    return fact.withColumn("region", G.zone_of(F.col("x"), F.col("y")).cast(fact.schema["region"].dataType))


def row_sums(df: DataFrame) -> list[str]:
    """Sums of row hashes: equal for equal rows, whatever their order and files."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    bits = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    return [str(x) for x in df.agg(F.count(F.lit(1)).alias("n"), *bits).first()]


def dataset_id(tables: dict[str, DataFrame], versions: dict) -> str:
    sums = {name: row_sums(df) for name, df in tables.items()}
    text = json.dumps([sorted(versions.items()), [[n, [list(p) for p in poly]] for n, poly in G.ZONES], sorted(sums.items())])
    return "v1-" + next(iter(tables.values())).sparkSession.range(1).select(F.sha2(F.lit(text), 256)).first()[0][:20]


def faults(fact: DataFrame, dim_match: DataFrame, dim_player: DataFrame) -> list[str]:
    """What keeps facts and dimensions from being a release. Both sides of a test are dealt by its keys, about ROWS of the larger table a task."""
    n = max(df.count() for df in (fact, dim_match, dim_player))
    by = lambda df, *on: dealt(df.select(*on), n, ROWS, *on)
    pid = lambda who: by(dim_player.select("match_id", F.col("pid").alias(f"{who}_pid")), "match_id", f"{who}_pid")
    of = lambda rows, dim, *on: orphans(by(rows, *on), dim, list(on))
    tests = {
        "duplicate": duplicates(by(fact, *IDENTITY), *IDENTITY), "duplicate match": duplicates(by(dim_match, "match_id"), "match_id"), "match": of(fact, by(dim_match, "match_id"), "match_id"),
        "victim": of(fact, pid("victim"), "match_id", "victim_pid"), "killer": of(fact.filter("killer_pid <> 0"), pid("killer"), "match_id", "killer_pid"),
    }
    return [name for name, rows in tests.items() if not rows.isEmpty()]


def bytes_per_row(columns: list[str]) -> int:
    """Bytes of a row in the wire types of its columns."""
    return sum(int(kind[1:]) // 8 for kind in wire_kinds(columns).values())


def written(df: DataFrame, path: str, order: list[str], n: int, **metrics: Column) -> dict:
    """Writes df, of about n rows, by ranges of the first of order, sorted, and returns metrics of its rows that the write itself has observed."""
    seen = Observation()
    rows = ranged(df, n, *order).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()])
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get


def publish(fact: DataFrame, dim_match: DataFrame, dim_player: DataFrame, root: str, versions: dict, guard: Callable[[], None] | None = None, fence: int | None = None) -> str:
    """Checks, writes and points to a release; one that is there whole is left alone. Returns its id. A release may have games without a fact, but not no game.

    guard is called last before the pointer moves. fence is the publisher's number among owners: once a later one has published,
    an earlier one cannot.
    """
    spark = fact.sparkSession
    if dim_match.isEmpty():
        raise ValueError("no games")
    fact = relabelled(fact)
    if found := faults(fact, dim_match, dim_player):
        raise ValueError(f"the release is not whole: {sorted(found)}")
    name = dataset_id({"fact_kill": fact, "dim_match": dim_match, "dim_participant": dim_player}, versions)
    if not files.exists(spark, f"{root}/manifest/{name}.json"):
        write(fact, dim_match, dim_player, root, name, versions)
    if guard:
        guard()
    point(spark, root, name, fence)
    return name


def write(fact: DataFrame, dim_match: DataFrame, dim_player: DataFrame, root: str, name: str, versions: dict) -> None:
    """The tables of release `name`, its validation report, and the manifest if all is as it should be."""
    spark, at = fact.sparkSession, lambda table_name: f"{root}/{table_name}/dataset_id={name}"
    start = F.col("game_start_ms")
    facts = written(fact, at("fact_kill"), list(IDENTITY), fact.count())
    games = written(dim_match, at("dim_match"), ["match_id"], dim_match.count(), first=F.min(start), last=F.max(start))
    people = written(dim_player, at("dim_participant"), ["match_id", "pid"], dim_player.count())
    patches = dense_keys(dim_match, "patch_id", "patch", MOST_PATCHES)
    keys = ranged_keys(dim_match, "match_id", "match", f"{root}/work/{name}/match_keys")
    keyed = dealt(keys, games["rows"], ROWS, "match_id").join(dealt(dim_match, games["rows"], ROWS, "match_id"), "match_id").join(F.broadcast(patches), "patch_id")
    written(keyed.select("match", "match_id", "patch", *[c for c in dim_match.columns if c not in ("match_id", "patch_id")]), at("matches"), ["match"], games["rows"])
    names = written(latest_names(dim_player).join(dense_keys(dim_player, "puuid", "player"), "puuid"), at("players"), ["player"], MOST_PLAYERS, last=F.max("player"))
    span = {r.patch_id: r.patch for r in patches.collect()}  # MOST_PATCHES at most
    made = wide(fact, dim_match, dim_player, f"{root}/work/{name}", facts["rows"])
    fault = _fault(games["rows"], len(span), names["rows"])
    shown = written(made.withColumn("_fault", fault), at("kills_wide"), list(IDENTITY), facts["rows"], **{f"fault {f}": F.count_if(F.col("_fault") == f) for f in FAULTS}, champion_kills=F.count_if(F.col("cause") == 0)) if "cause" in made.columns else written(made, at("kills_wide"), list(IDENTITY), facts["rows"])
    found = {f: n for f in FAULTS if (n := shown.get(f"fault {f}", 0))}
    report = {"dataset_id": name, "matches": games["rows"], "facts": facts["rows"], "wide_rows": shown["rows"], "participants": people["rows"], "duplicates": 0, "broken_references": 0, "faults": found}
    files.replace(spark, f"{root}/validation/{name}.json", json.dumps(report))
    if shown["rows"] != facts["rows"] or found or names["rows"] and names["last"] + 1 != names["rows"]:
        raise ValueError(f"the release is not whole: {report}")
    said = {"dataset_id": name, "versions": versions, "rows": facts["rows"], "matches": games["rows"], "players": names["rows"], "game_start": [games["first"], games["last"]], "patches": sorted(span, key=span.get), "regions": G.ZONE_NAMES, "champion_kills": shown.get("champion_kills"), "bytes_per_row": bytes_per_row(made.columns)}
    files.put(spark, f"{root}/manifest/{name}.json", json.dumps(said))


#: Pointers of one owner.
MOVES = 1_000_000


def point(spark: SparkSession, root: str, name: str, fence: int | None = None) -> None:
    """Moves the pointer: a file of the next number, created once. The greatest number counts."""
    number, now = _pointer(spark, root) or (0, "")
    if fence is not None and number // MOVES > fence:
        raise PermissionError(f"owner {number // MOVES} has published since owner {fence}")
    if now != name and not files.create(spark, f"{root}/current/{max(number, (fence or 0) * MOVES) + 1:018d}", name):
        raise PermissionError("another publisher was faster")


def _pointer(spark: SparkSession, root: str) -> tuple[int, str] | None:
    last = max((n for n in files.names(spark, f"{root}/current") if n.isdigit()), default=None)
    return None if last is None else (int(last), files.read(spark, f"{root}/current/{last}"))


def current(spark: SparkSession, root: str) -> str:
    found = _pointer(spark, root)
    if found is None:
        raise FileNotFoundError(f"no release under {root}")
    return found[1]


def table(spark: SparkSession, root: str, name: str, dataset: str | None = None) -> DataFrame:
    """A release's table; only that release's files are listed."""
    return spark.read.parquet(f"{root}/{name}/dataset_id={dataset or current(spark, root)}")


#: What a row of a wide table may have wrong: a place off the map, an unknown role, a key beyond its dimension, a killer's champion without a killer.
FAULTS = ("place", "role", "reference", "execution")


def _fault(matches: int, patches: int, players: int, regions: int = len(G.ZONE_NAMES)) -> Column:
    """The first of FAULTS that a row has, or null."""
    within = lambda c, n: F.coalesce(F.col(c).between(0, n - 1), F.lit(False))
    role = lambda c: F.col(c).isNull() | F.col(c).between(0, 4)
    tests = [
        F.col("x").between(G.MIN_X, G.MIN_X + G.SPAN_X) & F.col("y").between(G.MIN_Y, G.MIN_Y + G.SPAN_Y), role("victim_role") & role("killer_role"),
        within("match", matches) & within("patch", patches) & within("region", regions) & within("victim_player", players) & ((F.col("cause") != 0) | within("killer_player", players)),
        (F.col("cause") == 0) | F.col("killer_champ").isNull(),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in zip(FAULTS, tests, strict=True)])


def broken(facts: DataFrame, matches: int, patches: int, players: int, regions: int = len(G.ZONE_NAMES)) -> DataFrame:
    """Rows of a wide table that no release may have, with fault."""
    return facts.withColumn("fault", _fault(matches, patches, players, regions)).filter("fault is not null")


def ungrouped(facts: DataFrame) -> DataFrame:
    """Matches of a release's files whose rows are not in order within their part of a file. Rows are read where they lie: nothing is shuffled."""

    def descents(batches):
        last = None
        for batch in batches:
            if batch.num_rows:
                now = np.r_[batch.column(0).to_numpy()[:1] if last is None else last, batch.column(0).to_numpy()]
                last = now[-1:]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(now[1:][np.diff(now) < 0]), batch.schema.field(0).type)], ["match"])

    return facts.select("match").mapInArrow(descents, f"match {facts.schema['match'].dataType.simpleString()}").distinct()


def cells(facts: DataFrame, matches: int, patches: int, players: int) -> DataFrame:
    """rows, deaths and kills of a wide table by cell of the finest grid, champion kills apart from executions, and by fault: as many rows as the grid allows, whatever the table's size."""
    seen = H.perspectives(facts.withColumn("fault", _fault(matches, patches, players)), H.State())
    cell = G.cell_of(F.col("x"), F.col("y"), GRIDS[0]).alias("cell")
    return seen.groupBy(cell, (F.col("cause") == 0).alias("champion"), "fault").agg(F.count(F.lit(1)).alias("rows"), F.count_if("as_victim").alias("deaths"), F.count_if("as_killer").alias("kills"))


GRIDS = (128, 64, 32)


def _audited(found: list, said: dict) -> None:
    """An error unless the cells' counts add up to the manifest's, shares to 1, and cells of champion kills are even, on every grid."""
    faults = sorted({r.fault for r in found if r.fault})
    if faults:
        raise ValueError(f"a row has a fault: {faults}")
    total = sum(r.rows for r in found)
    if total != said["rows"] or sum(r.deaths for r in found) != total or sum(r.kills for r in found) != sum(r.rows for r in found if r.champion):
        raise ValueError("the tables are not those of the manifest: events are not counted once")
    for size in GRIDS:
        step = GRIDS[0] // size
        deaths, kills, even = Counter(), Counter(), {}
        for r in found:
            cell = r.cell // GRIDS[0] // step * size + r.cell % GRIDS[0] // step
            deaths[cell] += r.deaths
            kills[cell] += r.kills
            if r.champion:
                d, k = even.get(cell, (0, 0))
                even[cell] = d + r.deaths, k + r.kills
        for counts in (deaths, kills):
            n = sum(counts.values())
            if n and abs(sum(v / n for v in counts.values()) - 1) > 1e-5:
                raise ValueError(f"shares do not add up on the grid of {size}")
        if odd := [c for c, (d, k) in even.items() if d != k]:
            raise ValueError(f"champion kills without their deaths on the grid of {size}: cells {odd[:3]}")


def verified(spark: SparkSession, root: str, dataset: str | None = None) -> dict:
    """The manifest of a release that holds what it says; anything else is an error. The wide table is read once, and its matches' order once."""
    name = checked_id(dataset or current(spark, root))
    said = checked_manifest(json.loads(files.read(spark, f"{root}/manifest/{name}.json")))
    facts, players, games = (table(spark, root, t, name) for t in ("kills_wide", "players", "dim_match"))
    one = lambda df, key: tuple(dealt(df.select(key), df.count(), ROWS, key).groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(key)).first())
    if said["dataset_id"] != name or one(players, "puuid") != (said["players"],) * 2 or one(games, "match_id") != (said["matches"],) * 2:
        raise ValueError("the tables are not those of the manifest")
    _audited(cells(facts, said["matches"], len(said["patches"]), said["players"]).collect(), said)
    if not ungrouped(facts).isEmpty():
        raise ValueError("rows are not grouped by match")
    return said


#: What a manifest holds: type, and the least number that it may be.
MANIFEST = {"dataset_id": (str, None), "versions": (dict, None), "rows": (int, 0), "matches": (int, 1), "players": (int, 0), "game_start": (list, None), "patches": (list, None), "regions": (list, None), "champion_kills": ((int, type(None)), 0), "bytes_per_row": (int, 1)}


def checked_id(name: str) -> str:
    """A release's id as the pointer may name it."""
    if not re.fullmatch(r"v1-[0-9a-f]{20}", name):
        raise ValueError(f"no id of a release: {name!r}")
    return name


def checked_manifest(said: dict) -> dict:
    """A manifest of known keys, each of its type and range."""
    if wrong := set(said) ^ set(MANIFEST):
        raise ValueError(f"a manifest with unknown keys or without known ones: {sorted(wrong)}")
    for key, (kind, least) in MANIFEST.items():
        value = said[key]
        if not isinstance(value, kind) or isinstance(value, bool) or least is not None and value is not None and value < least:
            raise ValueError(f"the manifest's {key} cannot be {value!r}")
    checked_id(said["dataset_id"])
    return said


#: The columns that a first view needs; the others are in a file of their own.
CORE = ("match", "x", "y", "second", "region", "patch", "cause", "assists", "flags", "team_gold", "victim_champ", "victim_role", "victim_player", "killer_champ", "killer_role", "killer_player")


def wire_kinds(columns: list[str]) -> dict[str, str]:
    """The kinds of a wide table's numbers: keys of matches have four bytes, of players two, of patches one."""
    keys = {"match": "u32", "patch": "u8", "victim_player": "u16", "killer_player": "u16"}
    return {c: keys.get(c) or KINDS[c] for c in columns if c in keys or c in KINDS}


def export_columns(spark: SparkSession, root: str, path: str, dataset: str | None = None, gzip: bool = False) -> str:
    """A release's wide table as typed columns, path/<id>/core and path/<id>/extended, rows in order of match, frame and event."""
    typed_columns.register(spark)
    name = checked_id(dataset or current(spark, root))
    facts = table(spark, root, "kills_wide", name)
    kinds = wire_kinds(facts.columns)
    order = ["match", *IDENTITY[1:]]
    for group, own in (("core", [c for c in CORE if c in kinds]), ("extended", [c for c in kinds if c not in CORE])):
        rows = facts.select(*order, *[c for c in own if c not in order]).repartitionByRange("match").sortWithinPartitions(*order).select(*own)
        said = ",".join(f"{c}:{kinds[c]}" for c in own)
        rows.write.format("typed_columns").option("kinds", said).option("gzip", str(gzip).lower()).mode("append").save(f"{path}/{name}/{group}")
    return name


def register(spark: SparkSession, root: str, dataset: str | None = None) -> None:
    """The SQL surface: a view for each table of a release, a function <table>_of(id) for each table of any release, and the geometry as SQL functions.

    A function's id is no option: without one the query is an error, and with one only that release's folder is read.
    """
    from heatfield.functions.geometry import _zone

    for name in TABLES:
        table(spark, root, name, dataset).createOrReplaceTempView(name)
        every = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
        own = [c for c in every.schema if c.name != "dataset_id"]
        every.createOrReplaceTempView(f"{name}_every")
        columns, types = ", ".join(f"`{c.name}`" for c in own), ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in own)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_of(release STRING) RETURNS TABLE ({types}) RETURN SELECT {columns} FROM {name}_every WHERE dataset_id = {name}_of.release")
    spark.udf.register("zone_of", _zone)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION danger(d BIGINT, k BIGINT) RETURNS DOUBLE RETURN CASE WHEN d + k >= 5 THEN (d + 5.0D) / (d + k + 10.0D) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cell_of(x DOUBLE, y DOUBLE, g INT) RETURNS INT RETURN greatest(0, least(g - 1, cast(floor((y + 120) / 15100D * g) as int))) * g + greatest(0, least(g - 1, cast(floor((x + 120) / 14990D * g) as int)))")
