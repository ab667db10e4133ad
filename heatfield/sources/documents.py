"""Schemas and readers of match and timeline documents, and what keeps a document out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.functions.scalars import IMPUTED, ROLES, patch_of  # noqa: F401

MATCH = """metadata struct<matchId:string>, info struct<gameVersion:string, mapId:int, queueId:int, gameCreation:bigint,
gameStartTimestamp:bigint, gameEndTimestamp:bigint, gameDuration:bigint, endOfGameResult:string,
participants:array<struct<participantId:int, puuid:string, championId:int, teamId:int, teamPosition:string,
individualPosition:string, riotIdGameName:string, riotIdTagline:string, win:boolean, kills:int, deaths:int, teamEarlySurrendered:boolean>>>"""
EVENT = """struct<type:string, timestamp:bigint, participantId:int, level:int, killerId:int, victimId:int, monsterType:string,
monsterSubType:string, position:struct<x:double,y:double>, assistingParticipantIds:array<int>, bounty:bigint, shutdownBounty:bigint,
victimDamageReceived:array<struct<type:string, name:string, participantId:int, physicalDamage:bigint, magicDamage:bigint, trueDamage:bigint>>>"""
TIMELINE = f"""metadata struct<matchId:string>, info struct<frameInterval:bigint, frames:array<struct<timestamp:bigint,
participantFrames:map<string,struct<participantId:int, position:struct<x:double,y:double>, totalGold:bigint, minionsKilled:int, jungleMinionsKilled:int, level:int>>,
events:array<{EVENT}>>>>"""
#: The map, the queue and the least length in seconds that are taken.
MAP_ID, QUEUE_ID, MIN_SECONDS = 11, 420, 300
MATCH_ID = "^[A-Z0-9]+_[0-9]+$"


def read_documents(spark: SparkSession, path: str, schema: str, whole: bool = True) -> DataFrame:
    """JSON documents, gzipped or not, one a file, or one a line if they are not whole files."""
    return spark.read.schema(schema).json(path, multiLine=whole).withColumn("file", F.input_file_name())


def write_documents(docs: DataFrame, path: str) -> None:
    """docs as gzipped JSON, one a line, without absent fields; the folder is there whole or not at all, and is never written twice."""
    docs.write.option("compression", "gzip").mode("error").json(path)


def seconds(info: str = "info") -> Column:
    """The duration is in seconds where an end is recorded, else in milliseconds."""
    d = F.col(f"{info}.gameDuration")
    return F.when(F.col(f"{info}.gameEndTimestamp").isNotNull(), d).otherwise(d / 1000)


def rejection(patches: list[str] | None = None, info: str = "info") -> Column:
    """The first reason against a match, or null. Absent map or queue is a reason; an absent result is none."""
    i = lambda c: F.col(f"{info}.{c}")
    early = F.exists(F.coalesce(i("participants"), F.array()), lambda p: F.coalesce(p.teamEarlySurrendered, F.lit(False)))
    tests = [(~i("mapId").eqNullSafe(MAP_ID), "wrong_map"), (~i("queueId").eqNullSafe(QUEUE_ID), "wrong_queue"), (F.coalesce(i("endOfGameResult"), F.lit("GameComplete")) != "GameComplete", "not_complete"), (early, "early_surrender"), (F.coalesce(seconds(info), F.lit(0)) < MIN_SECONDS, "too_short"), (F.size(F.coalesce(i("participants"), F.array())) != 10, "bad_participant_count")]
    tests += [(~patch_of(i("gameVersion")).isin(patches), "out_of_patch")] if patches else []
    return F.coalesce(*[F.when(test, reason) for test, reason in tests])


def identity_fault() -> Column:
    """What is wrong with a match's participants, or null: ids 1 to 10, five a team, and a player each."""
    p = F.col("info.participants")
    ids = F.array_sort(F.transform(p, lambda x: x.participantId))
    team = lambda t: F.size(F.filter(p, lambda x: x.teamId == t))
    out = F.when(~F.coalesce(F.col("metadata.matchId").rlike(MATCH_ID), F.lit(False)), "match_id").when(~ids.eqNullSafe(F.sequence(F.lit(1), F.lit(10))), "ids")
    return out.when((team(100) != 5) | (team(200) != 5), "teams").when(F.exists(p, lambda x: F.coalesce(x.puuid, F.lit("")) == ""), "player")


def timeline_fault(info: str = "info") -> Column:
    """What is wrong with a timeline, or null: another match's, frames there, numbered by finite times and in order, events with known players, times and places in range."""
    frames = F.col(f"{info}.frames")
    at = F.transform(frames, lambda f: f.timestamp)
    events = F.flatten(F.transform(frames, lambda f: F.coalesce(f.events, F.array().cast(f"array<{EVENT}>"))))
    kills = F.filter(events, lambda e: e.type == "CHAMPION_KILL")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= 32767)
    bad = lambda e: (e.timestamp < 0) | (e.timestamp >= 65_535_000) | ~finite(e.position.x) | ~finite(e.position.y) | ~e.victimId.between(1, 10) | ~F.coalesce(e.killerId, F.lit(0)).between(0, 10)
    gone = F.exists(at, lambda t: t.isNull())
    return F.when(F.coalesce(F.size(frames), F.lit(0)) <= 0, "no_frames").when(gone, "frame_time").when(at != F.array_sort(at), "order").when(F.exists(kills, lambda e: F.coalesce(bad(e), F.lit(True))), "event")


def players(matches: DataFrame) -> DataFrame:
    """match_id and players, in order: pid, puuid, champ, role, team, won, imputed, and the lane opponent's pid and champ (of the other team's players of the role the last; none for an unknown role)."""
    return _opposed(matches, ("display_name", "deaths"))


def _opposed(matches: DataFrame, leave: tuple[str, ...]) -> DataFrame:
    one = lambda p: F.struct(*[c.alias(n) for n, c in _player(lambda f: p[f]).items() if n not in leave])
    rows = matches.select(F.col("metadata.matchId").alias("match_id"), F.transform("info.participants", one).alias("ps"))
    foe = lambda p: F.try_element_at(F.filter("ps", lambda q: (q["team"] == 300 - p["team"]) & (q["role"] == p["role"])), F.lit(-1))
    return rows.select("match_id", F.transform("ps", lambda p: p.withField("opp", foe(p)["pid"]).withField("opp_champ", foe(p)["champ"])).alias("players"))


def _player(p: Callable[[str], Column]) -> dict[str, Column]:
    """A player's columns from the fields of a participant."""
    text = lambda f: F.coalesce(p(f), F.lit(""))
    said, other = F.trim(text("teamPosition")), F.trim(text("individualPosition"))
    pos = F.when(said != "", said).otherwise(F.when(F.lower(other) == "invalid", "").otherwise(other))
    role = F.array_position(F.array(*map(F.lit, ROLES)), pos).cast("int") - 1
    name = F.when(text("riotIdGameName") != "", F.concat(p("riotIdGameName"), F.lit("#"), text("riotIdTagline"))).otherwise(F.concat(F.lit("Player "), F.substring(p("puuid"), 1, 8)))
    return {"pid": p("participantId"), "puuid": p("puuid"), "champ": F.coalesce(p("championId"), F.lit(0)), "role": F.when(role >= 0, role), "team": F.coalesce(p("teamId"), F.lit(100)), "won": F.coalesce(p("win"), F.lit(False)), "imputed": said == "", "display_name": name, "deaths": p("deaths")}


def participants(matches: DataFrame) -> DataFrame:
    """One row a player: match_id, place, pid, puuid, champ, role, team, won, imputed, name, and the lane opponent's pid and champ. Opponents are found within a match's document: nothing is shuffled."""
    p = _opposed(matches, ()).select("match_id", F.posexplode("players").alias("place", "p"))
    return p.select("match_id", "place", "p.*")


def lane_opponents(players: DataFrame) -> DataFrame:
    """players(match_id, team, role, place, pid, champ) with opp and opp_champ: of the other team's players of the role the last by place; none for an unknown role."""
    foe = players.filter("role is not null").groupBy("match_id", (300 - F.col("team")).alias("team"), "role").agg(F.max_by(F.struct(F.col("pid").alias("opp"), F.col("champ").alias("opp_champ")), "place").alias("foe"))
    return players.join(foe, ["match_id", "team", "role"], "left").select(*players.columns, "foe.opp", "foe.opp_champ")
