"""What the collector decides, as set operations over tables: whom to ask, what is settled, how much to take."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Platforms by the cluster that holds their matches.
REGIONS = {"americas": ("br1", "la1", "la2", "na1"), "asia": ("jp1", "kr"), "europe": ("eun1", "euw1", "me1", "ru", "tr1"), "sea": ("oc1", "sg2", "tw2", "vn2")}


def pairs(header: Column) -> Column:
    """A header such as 20:1,100:120 as a map of seconds to limits, {1: 20, 120: 100}; blank and bad parts fall away, of two limits for one window the last stays."""
    parts = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda p: F.regexp_extract_all(p, F.lit(r"^\s*([+-]?[0-9]{1,9})\s*:\s*([+-]?[0-9]{1,9})\s*$"), F.lit(0)))
    said = F.transform(F.flatten(parts), lambda p: F.struct(F.trim(F.substring_index(p, ":", -1)).cast("int").alias("key"), F.trim(F.substring_index(p, ":", 1)).cast("int").alias("value")))
    last = F.filter(said, lambda x, i: ~F.exists(F.slice(said, i + 2, F.size(said)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def platform_of(match_id: Column) -> Column:
    return F.lower(F.substring_index(match_id, "_", 1))


def region_of(match_id: Column) -> Column:
    """The cluster of a match; null if its platform is unknown."""
    return F.coalesce(*[F.when(platform_of(match_id).isin(*names), region) for region, names in REGIONS.items()])


def first_tier(ladder: DataFrame, tiers: Sequence[str], key: str = "puuid", tier: str = "tier") -> DataFrame:
    """One row a player: the one of the first tier in order."""
    order = F.array_position(F.array(*map(F.lit, tiers)), F.col(tier))
    return ladder.groupBy(key).agg(F.min_by(F.struct(*[c for c in ladder.columns if c != key]), order).alias("r")).select(key, "r.*")


def settled(records: DataFrame, schema: int, scope: str) -> DataFrame:
    """match_id of records(match_id, status, schema, scope) that need no second look: committed under this schema, or rejected under the same scope."""
    done = (F.col("status") == "done") & (F.col("schema") == schema)
    gone = (F.col("status") == "rejected") & F.col("scope").eqNullSafe(scope)
    return records.filter(done | gone).select("match_id").distinct()


def unsettled(ids: DataFrame, done: DataFrame) -> DataFrame:
    """match_id of ids, once each, that are not in done."""
    return ids.select("match_id").distinct().join(done.select("match_id"), "match_id", "left_anti")


def newest(histories: DataFrame, depth: int) -> DataFrame:
    """The newest `depth` matches of each player of histories(puuid, match_id, created), with place from 1."""
    place = F.row_number().over(Window.partitionBy("puuid").orderBy(F.desc("created"), "match_id"))
    return histories.withColumn("place", place).filter(F.col("place") <= depth)


def candidates(histories: DataFrame, done: DataFrame, depth: int = 100) -> DataFrame:
    """The newest `depth` matches of each player of histories(puuid, match_id, created), once each, without settled ones."""
    return unsettled(newest(histories, depth).select("match_id"), done)


def shuffled(rows: DataFrame, key: str, run: str) -> DataFrame:
    """rows with order: a pseudo-random place that run and key fix, the same on every attempt."""
    return rows.withColumn("order", F.sha2(F.concat(F.lit(run), F.col(key).cast("string")), 256))


def sample(rows: DataFrame, want: int, key: str, run: str) -> DataFrame:
    """The first `want` rows in the run's order."""
    return shuffled(rows, key, run).orderBy("order").limit(want)


def quota(rows: DataFrame, want: int | None, key: str, run: str, good: Column) -> DataFrame:
    """The first `want` good rows in the run's order. Rows that fail do not use up the quota."""
    return shuffled(rows.filter(good), key, run) if want is None else sample(rows.filter(good), want, key, run)


def dedupe_report(scratch: DataFrame, done: DataFrame) -> DataFrame:
    """One row: rows, distinct, duplicates, settled and backlog of scratch(match_id)."""
    ids = scratch.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    told = ids.join(done.select("match_id", F.lit(True).alias("done")), "match_id", "left")
    n, d, s = F.sum("n"), F.count(F.lit(1)), F.count_if("done")
    return told.agg(F.coalesce(n, F.lit(0)).alias("n_rows"), d.alias("n_distinct"), (F.coalesce(n, F.lit(0)) - d).alias("duplicates"), s.alias("settled"), (d - s).alias("backlog"))


def backlog(scratch: DataFrame, done: DataFrame, *order: str) -> DataFrame:
    """The compacted backlog: the first row of each match that is not settled."""
    first = scratch.groupBy("match_id").agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")
    return first.join(done.select("match_id"), "match_id", "left_anti")
