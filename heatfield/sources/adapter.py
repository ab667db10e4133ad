"""Event rows as kill facts, or as match and timeline documents, by integer arithmetic alone, so that any engine makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.functions import geometry as G
from heatfield.operators.asof import dealt
from heatfield.sources import documents as D

#: name: (expression in both dialects; // is integer division)
COLUMNS = {
    "match": "event_id // 28",
    "x": "event_id * 7919 % 14990 - 120",
    "y": "event_id * 104729 % 15100 - 120",
    "cause": "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END",
    "flags": "user_id % 2",
    "second": "event_id * 37 % 2400",
    "team_gold": "CAST(floor(value * 100) AS BIGINT) - 25000",
    "assists": "event_id % 5",
    "patch": "event_id % 3",
    "victim_champ": "user_id % 7",
    "victim_role": "event_id % 5",
    "victim_player": "user_id",
    "victim_lane_gold": "event_id * 911 % 4001 - 2000",
    "killer_champ": "CASE WHEN event_type = 'click' THEN (user_id * 3 + 1) % 7 END",
    "killer_role": "CASE WHEN event_type = 'click' THEN event_id // 3 % 5 END",
    "killer_player": "CASE WHEN event_type = 'click' THEN (user_id * 7 + 3) % 15 END",
    "killer_lane_gold": "CASE WHEN event_type = 'click' THEN event_id * 577 % 4001 - 2000 END",
}

#: Events whose documents a task makes, about: those of 256 matches.
EACH = 28 * 256


def facts(spark: SparkSession, sf_dir: str, zones: bool = True) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = ev.select("event_id", "user_id", "ts", *[F.expr(e.replace("//", "div")).alias(c) for c, e in COLUMNS.items()])
    return out.withColumn("region", G.zone_of(F.col("x"), F.col("y")).cast("long")) if zones else out.withColumn("region", F.lit(0).cast("long"))


def facts_sql(zones: bool = True) -> str:
    zone = G.zone_sql("u", "v") if zones else "0"
    cols = ", ".join(f'{e} AS "{c}"' for c, e in COLUMNS.items())
    return f"""k AS (SELECT *, CAST({zone} AS BIGINT) AS region FROM (SELECT *, (x + 120) / 14990e0 AS u, (y + 120) / 15100e0 AS v FROM (SELECT event_id, user_id, ts, {cols} FROM events)))"""


def cell_sql(size: int) -> str:
    return f"(greatest(0, least({size - 1}, CAST(floor(v * {size}) AS INTEGER))) * {size} + greatest(0, least({size - 1}, CAST(floor(u * {size}) AS INTEGER))))"


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Match and timeline documents: 28 events a match, seven a frame. Clicks are kills, errors executions, signups levels, purchases dragons, views buildings."""
    e = "event_id % 28"
    ms = f"({e} div 2) * 120000 + ({e} % 2) * 3000"
    victim = f"cast((user_id * 3 + {e}) % 10 + 1 as int)"
    event = f"""named_struct('type', CASE event_type WHEN 'click' THEN 'CHAMPION_KILL' WHEN 'error' THEN 'CHAMPION_KILL' WHEN 'signup' THEN 'LEVEL_UP' WHEN 'purchase' THEN 'ELITE_MONSTER_KILL' ELSE 'BUILDING_KILL' END,
        'timestamp', {ms}, 'participantId', user_id % 10 + 1, 'level', event_id % 18, 'victimId', {victim}, 'killerId', if(event_type = 'click', {victim} % 10 + 1, 0),
        'monsterType', 'DRAGON', 'monsterSubType', if(event_id % 5 = 0, 'ELDER_DRAGON', 'FIRE_DRAGON'), 'position', named_struct('x', event_id * 7919 % 14000, 'y', event_id * 104729 % 14000),
        'assistingParticipantIds', array_repeat(1, cast(event_id % 4 as int)), 'bounty', 300, 'shutdownBounty', event_id % 200,
        'victimDamageReceived', array(named_struct('type', 'TOWER', 'physicalDamage', 5), named_struct('type', 'MINION', 'physicalDamage', event_id % 10)))"""
    player = "named_struct('participantId', p, 'puuid', concat('p', (m * 3 + p) % 40), 'championId', 10 + p, 'teamId', if(p <= 5, 100, 200), 'teamPosition', array('TOP', 'JUNGLE', 'MIDDLE', 'BOTTOM', 'UTILITY')[(p - 1) % 5], 'win', p <= 5)"
    match = f"named_struct('metadata', named_struct('matchId', concat('EU_', m)), 'info', named_struct('gameVersion', '14.3.1', 'mapId', 11, 'queueId', 420, 'gameCreation', m, 'gameDuration', 1800000, 'participants', transform(sequence(1, 10), p -> {player})))"
    state = "named_struct('participantId', p, 'totalGold', 500 + f * 1000 + p * (m % 7 + 1) * 10, 'minionsKilled', f * 10 + p, 'position', named_struct('x', p * 1000 + f * 10, 'y', p * 900))"
    frame = f"named_struct('timestamp', f * 420000, 'participantFrames', map_from_entries(transform(sequence(1, 10), p -> struct(cast(p as string), {state}))), 'events', events)"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = rows.count()
    rows = dealt(rows.select("event_id", "user_id", "event_type", F.expr("event_id div 28").alias("m")), n, EACH, "m")
    ev = rows.select("m", F.expr(f"({e}) div 7").alias("f"), F.struct(F.expr(f"{e}").alias("i"), F.expr(event).alias("e")).alias("x"))
    frames = ev.groupBy("m", "f").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("events"))
    frames = frames.select("m", F.struct("f", F.to_json(F.expr(frame)).alias("frame")).alias("x"))
    lines = frames.groupBy("m").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["frame"]), ",").alias("frames"))
    text = F.concat(F.lit('{"metadata": {"matchId": "EU_'), F.col("m").cast("string"), F.lit('"}, "info": {"frames": ['), F.col("frames"), F.lit("]}}"))
    # The number comes from an aggregate, so that filters on the documents run over matches and not over events.
    keyed = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr("event_id div 28").alias("of"))
    numbers = dealt(keyed, n, 16 * EACH, "of").groupBy("of").agg(F.expr("max(event_id) div 28").alias("m")).select("m")
    matches = numbers.select(F.from_json(F.to_json(F.expr(match)), D.MATCH).alias("d")).select("d.*")
    return matches, lines.select(F.from_json(text, D.TIMELINE).alias("d")).select("d.*")
