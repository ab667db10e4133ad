"""Match and timeline documents to one row a champion kill.

A document is read once: its events become one array, in which each kill has the players' states of the last frame at or
before it, or of the first, and which is exploded. Every running state of the replay (levels, deaths, kills, who is alive, which
objectives are up) is a window over the rows of a match or player before the kill, in order of time, frame and event. All
windows, the join with the match's players and the gathering of a kill's ten players into one array for distances find
the rows dealt by match, so each side is shuffled once. The timelines are counted first, so that a task replays about MATCHES
of them, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatfield.functions import geometry as G
from heatfield.functions import scalars as S
from heatfield.operators.asof import dealt, prior
from heatfield.sources.documents import EVENT, participants, players

ORDER = ("event_ms", "frame_index", "event_index")
#: Fixed values, in milliseconds: first and next dragon, baron, and the herald's time.
DRAGON_FIRST, DRAGON_NEXT, BARON_FIRST, BARON_NEXT, HERALD_FROM, HERALD_TO, TRADE = 300_000, 300_000, 1_200_000, 360_000, 840_000, 1_500_000, 5_000
#: Matches that a task replays.
MATCHES = 256
KILL, LEVEL, MONSTER, BUILDING = "CHAMPION_KILL", "LEVEL_UP", "ELITE_MONSTER_KILL", "BUILDING_KILL"
BLOCK = ("champ", "role", "level", "gold_diff_lane", "cs_diff_lane", "isolation", "enemies_near", "ordinal", "since_prev_death", "lane_opp_champ", "player_id")


def cause(e: str = "e") -> Column:
    """champion with a killer, else by the largest source of damage (the first at a tie)."""
    total = lambda d: F.coalesce(d.physicalDamage, F.lit(0)) + F.coalesce(d.magicDamage, F.lit(0)) + F.coalesce(d.trueDamage, F.lit(0))
    best = F.array_max(F.transform(F.col(f"{e}.victimDamageReceived"), lambda d, i: F.struct(total(d).alias("n"), (-i).alias("i"), F.upper(F.coalesce(d.type, F.lit(""))).alias("t")))).t
    return F.when(F.coalesce(f"{e}.killerId", F.lit(0)) != 0, S.CHAMPION).when(best.rlike("TURRET|TOWER"), S.TURRET).when(best.contains("MINION"), S.MINION).when(best.contains("MONSTER"), S.MONSTER).otherwise(S.UNKNOWN)


def events(timelines: DataFrame) -> DataFrame:
    frames = timelines.select(F.col("metadata.matchId").alias("match_id"), F.posexplode("info.frames").alias("frame_index", "f"))
    return frames.select("match_id", "frame_index", F.posexplode("f.events").alias("event_index", "e")).withColumn("event_ms", F.coalesce("e.timestamp", F.lit(0)))


def replayed(timelines: DataFrame) -> DataFrame:
    """match_id, ORDER, e of the events that the replay needs, and states: for a kill the player states of the last frame at or before it, or of the first."""
    frames = F.col("frames")
    times = F.array_sort(F.transform(frames, lambda f, i: F.struct(F.coalesce(f.timestamp, F.lit(0)).alias("at"), i.alias("i"))))

    def row(e: Column, i: Column, j: Column) -> Column:
        t = F.coalesce(e.timestamp, F.lit(0))
        at = F.coalesce(F.try_element_at(F.filter("times", lambda x: x.at <= t), F.lit(-1)), F.get("times", F.lit(0)))
        return F.struct(i.alias("frame_index"), j.alias("event_index"), t.alias("event_ms"), e.alias("e"), F.when(e.type == KILL, F.get("frames", at.i).participantFrames).alias("states"))

    none = F.array().cast(f"array<{EVENT}>")
    rows = F.flatten(F.transform(frames, lambda f, i: F.filter(F.transform(F.coalesce(f.events, none), lambda e, j: row(e, i, j)), lambda x: x.e.type.isin(KILL, LEVEL, MONSTER, BUILDING))))
    docs = timelines.select(F.col("metadata.matchId").alias("match_id"), F.col("info.frames").alias("frames")).withColumn("times", times)
    return docs.select("match_id", rows.alias("rows")).select("match_id", F.inline("rows"))


def state(s: Column) -> list[Column]:
    """gold, cs, px, py of a player's state in a frame."""
    both = s["position"]["x"].isNotNull() & s["position"]["y"].isNotNull()
    cs = F.coalesce(s["minionsKilled"], F.lit(0)) + F.coalesce(s["jungleMinionsKilled"], F.lit(0))
    return [s["totalGold"].alias("gold"), F.when(s.isNotNull(), cs).alias("cs"), F.when(both, s["position"]["x"]).alias("px"), F.when(both, s["position"]["y"]).alias("py")]


def objectives_up(t: Column, by: list[str], order: tuple[str, ...]) -> Column:
    """Bits of the objectives that are up at t (milliseconds), from the rows before this one, whose dragon and baron are the times of such kills, elder and herald true at theirs."""
    w = prior(by, *order)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    up = F.when(t >= F.coalesce(last("dragon") + DRAGON_NEXT, F.lit(DRAGON_FIRST)), F.when(F.coalesce(last("elder"), F.lit(False)), S.ELDER).otherwise(S.DRAGON)).otherwise(0)
    up = up + F.when(t >= F.coalesce(last("baron") + BARON_NEXT, F.lit(BARON_FIRST)), S.BARON).otherwise(0)
    return up + F.when(last("herald").isNull() & (t >= HERALD_FROM) & (t < HERALD_TO), S.HERALD).otherwise(0)


def first_of_match(t: Column, *by: str) -> Column:
    """Whether a row has the least time of its match; all that share it do."""
    return t == F.min(t).over(Window.partitionBy(*by))


def near(own: Column, others: Column, mine, foe) -> tuple[Column, Column]:
    """Distance to the nearest of `others` for which mine(other) holds, and how many of those with foe(other) are within NEAR_RADIUS; own and others have px and py."""
    far = lambda p: F.hypot(p["px"] - own["px"], p["py"] - own["py"])
    placed = F.filter(others, lambda p: p["px"].isNotNull())
    return F.array_min(F.transform(F.filter(placed, mine), far)), F.size(F.filter(placed, lambda p: foe(p) & (far(p) <= G.NEAR_RADIUS)))


def kill_facts(matches: DataFrame, timelines: DataFrame) -> DataFrame:
    """The fact rows of all matches; unknown values are null."""
    ev, t = dealt(replayed(timelines), timelines.count(), MATCHES, "match_id"), F.col("event_ms")
    kill, monster = F.col("e.type") == KILL, F.when(F.col("e.type") == MONSTER, F.upper(F.coalesce("e.monsterType", F.lit(""))))
    sub, is_dragon = F.upper(F.coalesce("e.monsterSubType", F.lit(""))), monster.contains("DRAGON")
    baron = ~is_dragon & monster.contains("BARON")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = ev.select(
        "match_id", *ORDER, kill.alias("kill"), "states", F.when(F.col("e.type") == LEVEL, F.col("e.participantId")).alias("levelled"), F.when(F.col("e.level") > 0, F.col("e.level")).alias("up"),
        F.col("e.victimId").alias("victim_pid"), n("e.killerId").alias("killer_said"), cause().alias("cause"), F.col("e.position.x").alias("rx"), F.col("e.position.y").alias("ry"), F.coalesce(F.size("e.assistingParticipantIds"), F.lit(0)).alias("assist_n"), (n("e.bounty") + n("e.shutdownBounty")).alias("bounty_gold"),
        F.when(is_dragon, t).alias("dragon"), F.when(is_dragon & (sub.contains("ELDER") | monster.contains("ELDER")), True).alias("elder"), F.when(baron, t).alias("baron"), F.when(~is_dragon & ~baron & monster.contains("HERALD"), True).alias("herald"), F.when(F.col("e.type").isin(MONSTER, BUILDING), t).alias("objective"),
    )
    by, close = Window.partitionBy("match_id"), Window.partitionBy("match_id").orderBy("event_ms")
    at_kill = F.when(F.col("kill"), t)
    rows = rows.withColumns({"objectives_up": objectives_up(t, ["match_id"], ORDER), "since_objective": S.u8((t - F.last("objective", ignorenulls=True).over(prior(["match_id"], *ORDER))) / 1000, 2)})
    rows = rows.withColumns({"first": t == F.min(at_kill).over(by), "trade": F.count(at_kill).over(close.rangeBetween(-TRADE, TRADE)) > F.count(at_kill).over(close.rangeBetween(0, 0))})

    # Ten rows a kill, one a player, with the level events between them.
    rows = rows.filter("kill and rx is not null and ry is not null or levelled is not null and up is not null").join(players(matches), "match_id")
    none = F.lit(None).cast(rows.schema["players"].dataType.elementType)
    own = F.when(F.exists("players", lambda p: p.pid == F.col("victim_pid")), F.transform("players", lambda p: F.struct(p.pid.alias("pid"), p.alias("p"), F.col("states")[p.pid.cast("string")].alias("s"))))
    level = F.array(F.struct(F.col("levelled").alias("pid"), none.alias("p"), F.lit(None).cast(rows.schema["states"].dataType.valueType).alias("s")))
    actors = rows.withColumn("who", F.explode(F.when(F.col("kill"), own).otherwise(level))).drop("players", "states").select("*", "who.pid", "who.p", *state(F.col("who.s"))).drop("who")
    actors = actors.withColumns({"died": F.col("kill") & (F.col("pid") == F.col("victim_pid")), "killed": F.col("kill") & (F.col("pid") == F.col("killer_said")) & (F.col("cause") == S.CHAMPION)})
    run = prior(["match_id", "pid"], *ORDER)
    actors = actors.withColumn("level", F.coalesce(F.last(F.when(~F.col("kill"), F.col("up")), ignorenulls=True).over(run), F.lit(1)))
    until = t + F.floor(S.respawn_seconds(F.col("level"), t / 60_000.0) * 1000)
    actors = actors.withColumn("until", F.when(F.col("died"), until))
    before = lambda c: F.count_if(c).over(run)
    actors = actors.withColumns({"alive": F.coalesce(F.last("until", ignorenulls=True).over(run) <= t, F.lit(True)), "last_death": F.last(F.when(F.col("died"), t), ignorenulls=True).over(run), "n_deaths": before(F.col("died")), "n_kills": before(F.col("killed"))})
    one = F.struct("p.*", "level", "alive", "last_death", "n_deaths", "n_kills", "gold", "cs", "px", "py")
    first = ["victim_pid", "killer_said", "cause", "rx", "ry", "assist_n", "bounty_gold", "first", "trade", "objectives_up", "since_objective"]
    rows = actors.filter("kill").groupBy("match_id", *ORDER).agg(*[F.first(c).alias(c) for c in first], F.collect_list(one).alias("ps"))

    pick = lambda pid: F.get(F.filter("ps", lambda p: p.pid == pid), F.lit(0))
    rows = rows.withColumns({"victim": pick(F.col("victim_pid")), "killer": F.when(F.col("cause") == S.CHAMPION, pick(F.col("killer_said")))})
    team_sum = lambda t: F.aggregate(F.filter("ps", lambda p: (p.team == t) & p.gold.isNotNull()), F.lit(0).cast("long"), lambda a, p: a + p.gold)
    alive = lambda t: F.least(F.lit(15), F.size(F.filter("ps", lambda p: (p.team == t) & p.alive)))
    flag = lambda c, bit: F.when(F.coalesce(c, F.lit(False)), bit).otherwise(0)
    v, k = F.col("victim"), F.col("killer")
    out = {
        "x": F.bround("rx").cast("int"), "y": F.bround("ry").cast("int"), "second": F.least(F.lit(65535), F.floor(F.col("event_ms") / 1000)).cast("int"), "assists": F.col("assist_n"), "bounty": F.least(F.lit(65535), F.col("bounty_gold")).cast("int"),
        "killer_pid": F.when(k.isNotNull(), F.col("killer_said")).otherwise(0), "alive_counts": F.shiftleft(alive(100), 4).bitwiseOR(alive(200)),
        "team_gold": S.i16(F.when(F.exists("ps", lambda p: p.gold.isNotNull()), team_sum(100) - team_sum(200))),
        "flags": flag(v.team == 200, S.RED) + flag(v.won, S.WON) + flag(F.col("first"), S.FIRST_BLOOD) + flag(G.under_turret(F.col("rx"), F.col("ry")), S.UNDER_TURRET) + flag(F.col("trade"), S.TRADE) + flag(v.imputed | F.coalesce(k.imputed, F.lit(False)), S.IMPUTED),
    }
    for who, c in (("victim", v), ("killer", k)):
        out |= {f"{who}_{name}": x for name, x in zip(BLOCK, _block(c, who), strict=True)}
    rows = rows.select("match_id", *ORDER, "victim_pid", "cause", *[x.alias(name) for name, x in out.items()], "objectives_up", "since_objective")
    return rows.withColumn("region", G.zone_of(F.col("x"), F.col("y")))


def _block(a: Column, who: str) -> list[Column]:
    foe = F.get(F.filter("ps", lambda p: p.pid == a.opp), F.lit(0))
    mate, foes = near(a, F.col("ps"), lambda p: (p.team == a.team) & (p.pid != a.pid) & p.alive, lambda p: (p.team != a.team) & p.alive)
    placed = a.px.isNotNull()
    return [
        a.champ, a.role, S.u8(a.level), S.i16(a.gold - foe.gold), S.i16(a.cs - foe.cs), S.u8(F.when(placed, mate) / 100), S.u8(F.when(placed, foes)),
        S.u8(a.n_deaths if who == "victim" else a.n_kills), S.u8((F.col("event_ms") - a.last_death) / 1000, 4), a.opp_champ, a.puuid,
    ]


def field_audit(rows: DataFrame, kind: str, json: Column) -> DataFrame:
    """How often each value of `kind` sets each field of a JSON object; a null field is not set."""
    fields = F.map_keys(F.map_filter(F.from_json(json, "map<string,string>"), lambda _, v: v.isNotNull()))
    return rows.select(kind, F.explode(fields).alias("field")).groupBy(kind, "field").agg(F.count(F.lit(1)).alias("n"))


def audit(timelines: DataFrame) -> DataFrame:
    """How often each event type sets each field."""
    ev = events(timelines).withColumn("type", F.col("e.type"))
    return field_audit(ev, "type", F.to_json("e"))


#: Least and greatest of the columns' wire types.
WIDTHS = {"u8": (0, 255), "u16": (0, 65_535), "i16": (-32_768, 32_767)}
KINDS = {"x": "i16", "y": "i16", "second": "u16", "assists": "u8", "bounty": "u16", "cause": "u8", "flags": "u8", "region": "u8", "alive_counts": "u8", "objectives_up": "u8", "since_objective": "u8", "team_gold": "i16"} | {f"{who}_{c}": kind for who in ("victim", "killer") for c, kind in (("champ", "u16"), ("role", "u8"), ("level", "u8"), ("gold_diff_lane", "i16"), ("cs_diff_lane", "i16"), ("isolation", "u8"), ("enemies_near", "u8"), ("ordinal", "u8"), ("since_prev_death", "u8"), ("lane_opp_champ", "u16"))}


def out_of_range(facts: DataFrame) -> DataFrame:
    """match_id and column of values that their wire type cannot hold. An unknown value can be held by all."""
    bad = [F.when(~F.col(c).between(*WIDTHS[kind]), c) for c, kind in KINDS.items() if c in facts.columns]
    return facts.select("match_id", F.explode(F.array_compact(F.array(*bad))).alias("column")).distinct()


def unreconciled(facts: DataFrame, matches: DataFrame, timelines: DataFrame) -> DataFrame:
    """Matches whose facts are not their source's kills, by identities and by the players' own death counts."""
    frames, none = F.col("info.frames"), F.array().cast(f"array<{EVENT}>")
    kills = F.flatten(F.transform(frames, lambda f, i: F.filter(F.transform(F.coalesce(f.events, none), lambda e, j: F.when(e.type == KILL, F.struct(i.alias("f"), j.alias("e")))), lambda x: x.isNotNull())))
    source = timelines.select(F.col("metadata.matchId").alias("match_id"), F.array_sort(kills).alias("source"))
    made = facts.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct(F.col("frame_index").alias("f"), F.col("event_index").alias("e")))).alias("made"))
    deaths = F.transform("info.participants", lambda p: p.deaths)
    told = matches.select(F.col("metadata.matchId").alias("match_id"), F.when(F.forall(deaths, lambda d: d.isNotNull()), F.aggregate(deaths, F.lit(0), lambda a, d: a + d)).alias("told"))
    both = source.join(made, "match_id", "full_outer").join(told, "match_id", "full_outer")
    odd = ~F.coalesce("source", F.array()).eqNullSafe(F.coalesce("made", F.array())) | (F.col("told") != F.size(F.coalesce("made", F.array())))
    return both.filter(odd).select("match_id").distinct()
