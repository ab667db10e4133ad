"""Registered queries of the analytics engine, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatfield.functions import geometry as G
from heatfield.functions import scalars as S
from heatfield.operators import collection as C
from heatfield.operators import facets as H
from heatfield.operators import facts as X
from heatfield.operators import release as R
from heatfield.operators.asof import asof, dealt, others_within, prior
from heatfield.sources import columns, files
from heatfield.sources import documents as D
from heatfield.sources.adapter import cell_sql, documents, facts, facts_sql
from heatfield.streaming import ingest as I
from heatfield.streaming.ingest import advanced, first_of, histories
from heatfield.streaming.state import Keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


K, KZ = facts_sql(False), facts_sql()
AGG = 'count(*) FILTER (WHERE dv) AS deaths, count(*) FILTER (WHERE dk) AS kills, count(DISTINCT "match") FILTER (WHERE dv) AS death_games, count(DISTINCT "match") FILTER (WHERE dk) AS kill_games, count(DISTINCT "match") AS games'


def seen_sql(v: str = "true", k: str = "true", where: str = "true", zones: bool = False) -> str:
    """Perspectives: rows where the subject died (dv) or killed a champion (dk)."""
    return f"WITH {KZ if zones else K}, s AS (SELECT * FROM (SELECT *, coalesce({v}, false) AS dv, coalesce(cause = 0 AND {k}, false) AS dk FROM k WHERE {where}) WHERE dv OR dk)"


def seen(spark: SparkSession, d: str, state: H.State = H.State(), zones: bool = False) -> DataFrame:  # noqa: B008
    return H.perspectives(facts(spark, d, zones), state)


@query(f"{seen_sql()} SELECT {cell_sql(32)} AS cell, {AGG} FROM s GROUP BY 1")
def grid_counts(spark, d):
    return H.grid(seen(spark, d), 32)


@query(f"{seen_sql()} SELECT {cell_sql(128)} AS cell, {AGG} FROM s GROUP BY 1")
def grid_counts_fine(spark, d):
    return H.grid(seen(spark, d), 128)


@query(f"{seen_sql()} SELECT {AGG} FROM s")
def layer_totals(spark, d):
    return H.totals(seen(spark, d))


@query(f"{seen_sql('victim_champ IN (1, 2) AND victim_champ <> 3 AND killer_role = 1', 'killer_champ IN (1, 2) AND killer_champ <> 3 AND victim_role = 1')} SELECT {cell_sql(32)} AS cell, {AGG} FROM s GROUP BY 1")
def facet_filter(spark, d):
    want = H.State(subject=H.Actor(champ=((1, False), (2, False), (3, True))), opponent=H.Actor(role=((1, False),)))
    return H.grid(seen(spark, d, want), 32)


@query(f"{seen_sql('flags = 1 AND coalesce(killer_player NOT IN (3, 10), true)', 'flags = 0 AND victim_player NOT IN (3, 10)')} SELECT {AGG} FROM s")
def actor_side(spark, d):
    want = H.State(subject=H.Actor(side=((200, False),)), opponent=H.Actor(player=((3, True), (10, True))))
    return H.totals(seen(spark, d, want))


@query(f"{seen_sql('victim_lane_gold BETWEEN 0 AND 1000', 'killer_lane_gold BETWEEN 0 AND 1000', 'second BETWEEN 300 AND 1500 AND team_gold BETWEEN -20000 AND 20000 AND assists BETWEEN 1 AND 3')} SELECT {AGG} FROM s")
def range_filter(spark, d):
    return H.totals(seen(spark, d, H.State(time=(300, 1500), team_gold=(-20000, 20000), assists=(1, 3), lane_gold=(0, 1000))))


@query(f"{seen_sql(where='cause IN (0, 2) AND patch <> 1 AND region IN (18, 19, 20, 21, 22, 23)', zones=True)} SELECT {AGG} FROM s")
def context_filter(spark, d):
    want = H.State(region=tuple((i, False) for i in range(18, 24)), cause=((0, False), (2, False)), patch=((1, True),))
    return H.totals(seen(spark, d, want, zones=True))


RATIO = "CASE WHEN deaths + kills >= 5 THEN round((deaths + 5e0) / (deaths + kills + 10e0), 6) END"


@query(f"{seen_sql()}, g AS (SELECT {cell_sql(32)} AS cell, {AGG} FROM s GROUP BY 1) SELECT cell, deaths, kills, {RATIO} AS danger, 1 - {RATIO} AS opportunity FROM g")
def danger_opportunity(spark, d):
    cells = H.grid(seen(spark, d), 32)
    v = F.round(H.danger(F.col("deaths"), F.col("kills")), 6)
    return cells.select("cell", "deaths", "kills", v.alias("danger"), (1 - v).alias("opportunity"))


@query(f"{seen_sql()}, g AS (SELECT {cell_sql(32)} AS cell, count(*) FILTER (WHERE dv) AS n FROM s GROUP BY 1), r AS (SELECT cell, n / sum(n) OVER () AS v FROM g), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS c FROM r WHERE v > 0) SELECT round((SELECT v FROM o WHERE i = least(c - 1, CAST(floor(c * 0.99e0) AS BIGINT))), 9) AS p99")
def share_p99(spark, d):
    return H.index_percentile(H.layer(H.grid(seen(spark, d), 32), "deaths"), "value", 0.99).select(F.round("value", 9).alias("p99"))


@query(f"{seen_sql()}, g AS (SELECT {cell_sql(32)} AS cell, {AGG} FROM s GROUP BY 1), r AS (SELECT abs((deaths + 5e0) / (deaths + kills + 10e0) - 0.5e0) AS v FROM g WHERE deaths + kills >= 5), o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS c FROM r WHERE v > 0) SELECT round(greatest(0.02e0, coalesce((SELECT v FROM o WHERE i = CAST(floor((c - 1) * 0.98e0) AS BIGINT)), 0)), 6) AS spread")
def ratio_spread(spark, d):
    return H.spread(H.layer(H.grid(seen(spark, d), 32), "danger")).select(F.round("spread", 6).alias("spread"))


@query(f"{seen_sql(zones=True)} SELECT region, {AGG} FROM s GROUP BY 1")
def zone_counts(spark, d):
    return H.by_zone(seen(spark, d, zones=True))


@query(f"{seen_sql(zones=True)}, z AS (SELECT region, {AGG} FROM s GROUP BY 1), r AS (SELECT region, deaths, kills, (deaths + 5e0) / (deaths + kills + 10e0) AS v, deaths + kills AS n FROM z WHERE deaths + kills >= 5) SELECT * FROM (SELECT region, round(v, 6) AS value, n, CAST(row_number() OVER (ORDER BY v DESC, n DESC, region) AS INTEGER) AS rank FROM r WHERE v > 0) WHERE rank <= 8")
def zone_summary_top(spark, d):
    return H.zone_summary(seen(spark, d, zones=True), "danger", 8).select("region", F.round("value", 6).alias("value"), "n", "rank")


_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(G.ZONE_NAMES))
_GROUP = "CASE WHEN contains(n, 'base') THEN 'Base' WHEN contains(n, 'lane') THEN 'Lane' WHEN contains(n, 'river') THEN 'River' WHEN contains(n, 'pit') THEN 'Objective' WHEN contains(n, 'brush') THEN 'Brush' WHEN regexp_matches(n, 'jungle|buff|raptor|wolves|gromp|krugs') THEN 'Jungle' ELSE 'Other' END"


@query(f"{seen_sql(zones=True)}, names(region, name) AS (VALUES {_NAMES}), j AS (SELECT s.*, lower(name) AS n FROM s JOIN names USING (region)) SELECT {_GROUP} AS zone_group, {AGG} FROM j GROUP BY 1")
def zone_groups(spark, d):
    return H.counts(seen(spark, d, zones=True), G.zone_group(G.zone_name(F.col("region").cast("int"))).alias("zone_group"))


@query(f"{seen_sql()}, g AS (SELECT {cell_sql(128)} AS cell, {AGG} FROM s GROUP BY 1) SELECT CAST((cell // 128 // 4) * 32 + (cell % 128) // 4 AS INTEGER) AS cell, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(kills) AS BIGINT) AS kills FROM g GROUP BY 1")
def grid_rollup(spark, d):
    fine = H.grid(seen(spark, d), 128)
    return fine.groupBy(G.coarser(F.col("cell"), 128, 32).alias("cell")).agg(F.sum("deaths").alias("deaths"), F.sum("kills").alias("kills"))


def _auto(size: int) -> str:
    return f"SELECT {cell_sql(size)} AS cell, {AGG}, {size} AS size FROM s, t WHERE t.size = {size} GROUP BY 1"


@query(f"{seen_sql()}, t AS (SELECT CASE WHEN n / 16384e0 >= 0.6 THEN 128 WHEN n / 4096e0 >= 0.6 THEN 64 ELSE 32 END AS size FROM (SELECT count(*) FILTER (WHERE dv) + count(*) FILTER (WHERE dk) AS n FROM s)) {_auto(128)} UNION ALL {_auto(64)} UNION ALL {_auto(32)}")
def grid_auto_size(spark, d):
    state = H.State(layer="danger")
    return H.auto_grid(seen(spark, d, state), state)


_KERNEL = ", ".join(f"({i - 4}, {w}e0)" for i, w in enumerate(H.KERNEL))


@query(f"{seen_sql()}, kern(o, w) AS (VALUES {_KERNEL}), g AS (SELECT {cell_sql(64)} AS cell, count(*) FILTER (WHERE dv) AS deaths, count(*) FILTER (WHERE dk) AS kills FROM s GROUP BY 1), a AS (SELECT cell % 64 + o AS bx, cell // 64 AS b_y, sum(deaths * w) AS deaths, sum(kills * w) AS kills FROM g, kern WHERE cell % 64 + o BETWEEN 0 AND 63 GROUP BY 1, 2), b AS (SELECT bx, b_y + o AS b_y, sum(deaths * w) AS deaths, sum(kills * w) AS kills FROM a, kern WHERE b_y + o BETWEEN 0 AND 63 GROUP BY 1, 2) SELECT CAST(b_y * 64 + bx AS INTEGER) AS cell, CAST(round(deaths * 1e8) AS BIGINT) AS deaths_e8, CAST(round(kills * 1e8) AS BIGINT) AS kills_e8, round((deaths * {H.evidence()!r}e0 + 5) / ((deaths + kills) * {H.evidence()!r}e0 + 10), 6) AS danger FROM b WHERE (deaths + kills) * {H.evidence()!r}e0 >= 5")
def gaussian_blur(spark, d):
    out = H.layer(H.blurred(H.grid(seen(spark, d), 64), 64), "danger", H.evidence())
    return out.filter("value is not null").select(F.col("cell").cast("int").alias("cell"), F.round(F.col("deaths") * 1e8).cast("long").alias("deaths_e8"), F.round(F.col("kills") * 1e8).cast("long").alias("kills_e8"), F.round("value", 6).alias("danger"))


@query(f"{seen_sql()}, w AS (SELECT unnest(range(greatest(0, CAST(ceil((second - 239) / 20e0) AS BIGINT)), second // 20 + 1)) * 20 AS start, dv, dk FROM s) SELECT CAST(start AS BIGINT) AS start, count(*) FILTER (WHERE dv) AS deaths, count(*) FILTER (WHERE dk) AS kills FROM w GROUP BY 1")
def sliding_playback(spark, d):
    return H.playback(seen(spark, d)).withColumn("start", F.col("start").cast("long"))


@query("SELECT p.event_id, coalesce(v.event_id, f.event_id) AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts LEFT JOIN (SELECT user_id, arg_min(event_id, ts) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1) f ON p.user_id = f.user_id")
def asof_view_before_purchase(spark, d):
    ev = read(spark, d, "events")
    got = asof(ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), ev.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("id")), ["user_id"], "ts", "view", first_if_none=True)
    return got.select("event_id", F.col("view.id").alias("view_id"))


@query("SELECT event_id, EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.ts <> e.ts AND abs(epoch_us(o.ts) - epoch_us(e.ts)) <= 3600000000) AS trade FROM events e")
def trade_interval(spark, d):
    ev = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ev.select("event_id", others_within(["user_id"], F.col("us"), 3_600_000_000).alias("trade"))


@query("SELECT event_id, ts = min(ts) OVER (PARTITION BY event_id // 28) AS first_blood FROM events")
def first_event(spark, d):
    ev = read(spark, d, "events").withColumn("match", F.expr("event_id div 28"))
    return ev.select("event_id", X.first_of_match(F.col("ts"), "match").alias("first_blood"))


@query("SELECT event_id, count(*) OVER w AS ordinal, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL THEN CAST(least(254, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 / 3600)) AS INTEGER) END AS since_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def replay_ordinals(spark, d):
    ev = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    w = prior(["user_id"], "us", "event_id")
    return ev.select("event_id", F.count(F.lit(1)).over(w).alias("ordinal"), S.u8((F.col("us") - F.last("us").over(w)) / 1e6, 3600).alias("since_last"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id % 18 + 1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS level FROM events")
def level_last_value(spark, d):
    up = F.when(F.col("event_type") == "signup", F.col("event_id") % 18 + 1)
    return read(spark, d, "events").select("event_id", F.coalesce(F.last(up, ignorenulls=True).over(prior(["user_id"], "ts", "event_id")), F.lit(1)).alias("level"))


@query("""WITH e AS (SELECT event_id, event_id // 28 AS m, event_id % 28 * 60 AS t, event_type AS e FROM events), w AS (SELECT *, last_value(CASE WHEN e = 'signup' THEN t END IGNORE NULLS) OVER p AS dragon, max(CASE WHEN e = 'signup' AND event_id % 3 = 0 THEN 1 END) OVER p AS elder, last_value(CASE WHEN e = 'purchase' THEN t END IGNORE NULLS) OVER p AS baron, max(CASE WHEN e = 'error' THEN 1 END) OVER p AS herald FROM e WINDOW p AS (PARTITION BY m ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CAST(CASE WHEN t >= coalesce(dragon + 300, 300) THEN CASE WHEN elder = 1 THEN 8 ELSE 1 END ELSE 0 END + CASE WHEN t >= coalesce(baron + 360, 1200) THEN 2 ELSE 0 END + CASE WHEN herald IS NULL AND t >= 840 AND t < 1500 THEN 4 ELSE 0 END AS INTEGER) AS up FROM w""")
def objective_mask(spark, d):
    ev = read(spark, d, "events").select("event_id", F.expr("event_id div 28").alias("m"), (F.col("event_id") % 28 * 60_000).alias("t"), F.col("event_type").alias("e"))
    at = lambda e: F.when(F.col("e") == e, F.col("t"))
    ev = ev.withColumns({"dragon": at("signup"), "elder": F.when((F.col("e") == "signup") & (F.col("event_id") % 3 == 0), True), "baron": at("purchase"), "herald": F.when(F.col("e") == "error", True)})
    return ev.select("event_id", X.objectives_up(F.col("t"), ["m"], ("t", "event_id")).alias("up"))


@query(f"WITH {K} SELECT a.event_id, CAST(floor(min(sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE))) FILTER (WHERE a.flags = b.flags) / 100) AS BIGINT) AS isolation, count(*) FILTER (WHERE a.flags <> b.flags AND sqrt(CAST((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS DOUBLE)) <= 2000) AS enemies_near FROM k a JOIN k b ON a.\"match\" = b.\"match\" AND a.event_id <> b.event_id GROUP BY 1")
def neighbours(spark, d):
    k = facts(spark, d, False).select("match", "event_id", F.col("x").alias("px"), F.col("y").alias("py"), "flags")
    games = k.groupBy("match").agg(F.collect_list(F.struct("event_id", "px", "py", "flags")).alias("ps")).filter(F.size("ps") > 1)

    def one(a):
        mate, foes = X.near(a, F.col("ps"), lambda p: (p["flags"] == a["flags"]) & (p["event_id"] != a["event_id"]), lambda p: p["flags"] != a["flags"])
        return F.struct(a["event_id"].alias("event_id"), F.floor(mate / 100).alias("isolation"), foes.cast("long").alias("enemies_near"))

    return games.select(F.inline(F.transform("ps", one)))


_TURRET = " OR ".join(f"sqrt(pow(x - ({u * G.SPAN_X + G.MIN_X!r}e0), 2) + pow(y - ({v * G.SPAN_Y + G.MIN_Y!r}e0), 2)) <= 775" for a, b in G.TURRETS for u, v in ((a, b), (1.0 - b, 1.0 - a)))


@query(f"WITH {K} SELECT event_id, ({_TURRET}) AS under_turret FROM k")
def under_turret(spark, d):
    return facts(spark, d, False).select("event_id", G.under_turret(F.col("x"), F.col("y")).alias("under_turret"))


@query(f"WITH {KZ} SELECT event_id, region AS zone FROM k")
def zone_labels(spark, d):
    return facts(spark, d).select("event_id", F.col("region").alias("zone"))


@query(f"WITH {K} SELECT event_id, round((1 - v) * 14990 - 120, 4) AS mx, round((1 - u) * 15100 - 120, 4) AS my, round(u * 512, 4) AS sx, round(512 * (1 - v), 4) AS sy, CASE WHEN second / 60e0 < 8 THEN '0-8' WHEN second / 60e0 < 14 THEN '8-14' WHEN second / 60e0 < 20 THEN '14-20' WHEN second / 60e0 < 30 THEN '20-30' ELSE '30+' END AS phase FROM k")
def mirror_and_phase(spark, d):
    x, y = F.col("x"), F.col("y")
    (mx, my), (sx, sy) = G.mirrored(x, y), G.on_screen(x, y, 512, 512)
    return facts(spark, d, False).select("event_id", F.round(mx, 4).alias("mx"), F.round(my, 4).alias("my"), F.round(sx, 4).alias("sx"), F.round(sy, 4).alias("sy"), S.phase(F.col("second") / 60).alias("phase"))


_LANE = "SELECT o_custkey % 100 AS m, o_orderkey % 2 * 100 + 100 AS team, nullif(o_orderkey % 6, 5) AS role, o_orderkey AS pid FROM orders"


@query(f"WITH p AS ({_LANE}), f AS (SELECT m, 300 - team AS team, role, max(pid) AS opp FROM p GROUP BY ALL) SELECT p.pid, f.opp FROM p LEFT JOIN f USING (m, team, role)")
def lane_opponent_self_join(spark, d):
    p = read(spark, d, "orders").selectExpr("o_custkey % 100 AS match_id", "o_orderkey % 2 * 100 + 100 AS team", "nullif(o_orderkey % 6, 5) AS role", "o_orderkey AS pid", "o_orderkey AS place", "o_orderkey AS champ")
    return D.lane_opponents(p).select("pid", "opp")


@query("SELECT count(*) AS orphans FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p_size > 10)")
def integrity_orphans(spark, d):
    dim = read(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return R.orphans(read(spark, d, "lineitem"), dim, ["l_partkey"]).agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_identity(spark, d):
    return R.duplicates(read(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n_rows, count(*) - count(DISTINCT l_orderkey) AS repeats, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem")
def count_filter(spark, d):
    return R.count_report(read(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", "l_shipdate").withColumnsRenamed({"matching": "returned", "first": "first_day", "last": "last_day"})


@query("SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS sk FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def surrogate_keys(spark, d):
    return R.dense_keys(read(spark, d, "customer"), "c_mktsegment", "sk")


@query("SELECT o_custkey, arg_max(o_orderpriority, lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS latest FROM orders GROUP BY 1")
def latest_name(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("puuid"), F.col("o_orderpriority").alias("display_name"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("match_id"))
    return R.latest_names(o).select(F.col("puuid").alias("o_custkey"), F.col("display_name").alias("latest"))


@query("WITH m AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS sk FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT l_orderkey, l_linenumber, o_custkey, CAST(sk AS INTEGER) AS segment_sk, n_name, s_name, count(*) AS copies FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN m USING (c_mktsegment) JOIN nation ON c_nationkey = n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_acctbal > 0 GROUP BY ALL")
def denormalise_release(spark, d):
    c, o = read(spark, d, "customer"), read(spark, d, "orders").select("o_orderkey", "o_custkey")
    named = c.join(F.broadcast(R.dense_keys(c, "c_mktsegment", "segment_sk")), "c_mktsegment").join(F.broadcast(read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "segment_sk", "n_name")
    supplier = read(spark, d, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name")
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    rows = lines.count()
    lines = dealt(lines, rows, R.ROWS, "l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    out = R.denormalised(lines, {"order": ("l_orderkey", o, "inner"), "customer": ("o_custkey", named, "inner"), "supplier": ("l_suppkey", supplier, "left")}, rows)
    return out.groupBy("l_orderkey", "l_linenumber", "o_custkey", "segment_sk", "n_name", "s_name").agg(F.sum("n").alias("copies"))


@query("SELECT o_orderkey, CASE WHEN nullif(o_custkey % 10, 0) IS NULL THEN 'wrong_map' WHEN o_custkey % 10 = 1 THEN 'wrong_queue' WHEN o_orderstatus = 'P' THEN 'not_complete' WHEN o_orderkey % 9 = 0 THEN 'early_surrender' WHEN (CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice // 1 ELSE (o_totalprice // 1) / 1000 END) < 300 THEN 'too_short' WHEN o_orderkey % 7 = 0 THEN 'bad_participant_count' WHEN o_orderkey % 5 = 0 THEN 'out_of_patch' END AS reason FROM orders")
def rejection_reason(spark, d):
    one = "named_struct('participantId', 1, 'teamEarlySurrendered', o_orderkey % 9 = 0)"
    info = f"""named_struct('mapId', if(o_custkey % 10 = 0, cast(null as int), 11), 'queueId', if(o_custkey % 10 = 1, 450, 420), 'endOfGameResult', if(o_orderstatus = 'P', 'Abort', null),
        'gameEndTimestamp', if(o_orderpriority like '1%', 1L, null), 'gameDuration', cast(floor(o_totalprice) as bigint), 'gameVersion', if(o_orderkey % 5 = 0, '13.1.1', '14.3.1'), 'participants', array_repeat({one}, if(o_orderkey % 7 = 0, 9, 10)))"""
    return read(spark, d, "orders").select("o_orderkey", F.expr(info).alias("info")).select("o_orderkey", D.rejection(["14.3"]).alias("reason"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_custkey % 3 <> 0) OR (o_orderstatus = 'P' AND o_custkey % 4 = 0))")
def settled_anti_join(spark, d):
    records = read(spark, d, "orders").selectExpr("o_orderkey AS match_id", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'rejected' ELSE 'error' END AS status", "if(o_custkey % 3 = 0, 0, 1) AS schema", "if(o_custkey % 4 = 0, '14.3', if(o_custkey % 4 = 1, null, '14.2')) AS scope")
    left = C.unsettled(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id")), C.settled(records, 1, "14.3"))
    return left.withColumnRenamed("match_id", "l_orderkey")


@query("SELECT o_custkey, arg_min(o_orderkey, o_orderpriority || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS first_order FROM orders GROUP BY 1")
def first_wins_dedupe(spark, d):
    return first_of(read(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT c_custkey, sha256('run-1' || CAST(c_custkey AS VARCHAR)) AS place FROM customer ORDER BY 2 LIMIT 250")
def hash_order_sample(spark, d):
    return C.sample(read(spark, d, "customer"), 250, "c_custkey", "run-1").select("c_custkey", F.col("order").alias("place"))


def _search_sql(q: str, letters: str) -> str:
    n = "regexp_replace(lower(label), '[^a-z0-9#]', '', 'g')"
    return f"WITH p AS (SELECT p_name || '#' || p_partkey AS label FROM part), s AS (SELECT label, CASE WHEN lower(label) = '{q}' THEN 0 WHEN starts_with({n}, '{letters}') THEN 1 WHEN contains({n}, '{letters}') THEN 2 WHEN regexp_matches({n}, '{'.*'.join(letters)}') THEN 3 END AS score FROM p) SELECT label, score FROM s WHERE score IS NOT NULL ORDER BY score, length(label), label LIMIT 60"


@query(_search_sql("large bolt#2", "largebolt#2"))
def fuzzy_search(spark, d):
    parts = read(spark, d, "part").select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("label"))
    return S.search(parts, " Large Bolt#2", "label")


@query("SELECT event_type, 'k' AS field, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1")
def json_prop_audit(spark, d):
    return X.field_audit(read(spark, d, "events"), "event_type", F.col("props"))


@query("SELECT c_custkey, CASE c_nationkey % 5 WHEN 0 THEN 'americas' WHEN 1 THEN 'asia' WHEN 2 THEN 'europe' WHEN 3 THEN 'sea' END AS region, c_custkey % 50 + 1 AS burst, CAST(c_custkey % 7 AS INTEGER) AS slow FROM customer")
def header_pairs(spark, d):
    route = F.get(F.array(*[F.lit(x) for x in ("NA1_", "KR_", "EUW1_", "OC1_", "XX_")]), F.col("c_nationkey") % 5)
    said = F.concat((F.col("c_custkey") % 50 + 1).cast("string"), F.lit(":1, ,x:5,"), (F.col("c_custkey") % 7).cast("string"), F.lit(":120"))
    limits = C.pairs(said)
    return read(spark, d, "customer").select("c_custkey", C.region_of(F.concat(route, F.col("c_custkey").cast("string"))).alias("region"), F.element_at(limits, F.lit(1)).cast("long").alias("burst"), F.element_at(limits, F.lit(120)).alias("slow"))


@query(f"WITH {K}, b AS (SELECT event_id, 'assists' AS c FROM k WHERE assists * 70 > 255 UNION ALL SELECT event_id, 'team_gold' FROM k WHERE team_gold * 2 NOT BETWEEN -32768 AND 32767) SELECT c AS column, count(*) AS n FROM b GROUP BY 1")
def fact_ranges(spark, d):
    k = facts(spark, d, False).withColumns({"match_id": F.col("event_id"), "assists": F.col("assists") * 70, "team_gold": F.col("team_gold") * 2})
    return X.out_of_range(k).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {K} SELECT fault, count(*) AS n FROM (SELECT CASE WHEN event_id % 11 = 0 THEN 'place' WHEN event_id % 6 = 5 THEN 'role' WHEN killer_player >= 12 OR victim_player >= 12 THEN 'reference' WHEN cause <> 0 AND event_id % 7 = 0 THEN 'execution' END AS fault FROM k) WHERE fault IS NOT NULL GROUP BY 1")
def release_faults(spark, d):
    k = facts(spark, d, False).withColumns({"x": F.when(F.col("event_id") % 11 == 0, 15_000).otherwise(F.col("x")), "victim_role": F.col("event_id") % 6, "killer_champ": F.when((F.col("event_id") % 7 == 0) | (F.col("cause") == 0), F.lit(1))})
    return R.broken(k, 1 << 30, 3, 12).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, value / 1000 AS lin, round(sqrt(value / 1000), 9) AS root, round(ln(1 + 9 * value / 1000) / ln(10), 9) AS log, CAST(greatest(-32767, least(32767, event_id * 7919 % 90000 - 45000)) AS INTEGER) AS gold FROM events WHERE value >= 0")
def layer_scales(spark, d):
    t = F.col("value") / 1000
    return read(spark, d, "events").filter("value >= 0").select("event_id", S.scaled(t, "lin").alias("lin"), F.round(S.scaled(t, "sqrt"), 9).alias("root"), F.round(S.scaled(t, "log"), 9).alias("log"), S.i16(F.col("event_id") * 7919 % 90000 - 45000).alias("gold"))


@query("SELECT event_id, CAST(greatest(0, least(254, floor(value / 4))) AS INTEGER) AS q, CAST(round_even(value, 0) AS INTEGER) AS half_even, round(list_extract([10, 10, 12, 12, 14, 16, 20, 21, 22, 24, 26, 28, 30, 32.5, 35, 37.5, 40, 42.5, 45, 47.5]::DOUBLE[], event_id % 20 + 1) * CASE WHEN event_id % 50 < 15 THEN 1 ELSE 1 + least(0.5e0, (event_id % 50 - 15) // 5 * 0.05e0) END, 6) AS respawn FROM events")
def signed_quantise(spark, d):
    return read(spark, d, "events").select("event_id", S.u8(F.col("value"), 4).alias("q"), F.bround("value").cast("int").alias("half_even"), F.round(S.respawn_seconds(F.col("event_id") % 20 + 1, F.col("event_id") % 50), 6).alias("respawn"))


@query("SELECT c_custkey, c_name AS shown, CASE WHEN round(c_acctbal) > 0 THEN '+' WHEN round(c_acctbal) < 0 THEN '-' ELSE '' END || printf('%.1fk', round(abs(round(c_acctbal)) / 1000, 1)) AS gold, printf('%d:%02d', c_custkey // 60, c_custkey % 60) AS clock FROM customer")
def text_formats(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.player_name(F.concat("c_name", F.lit("#x"))).alias("shown"), S.kilo_gold(F.round("c_acctbal")).alias("gold"), S.minutes_seconds(F.col("c_custkey")).alias("clock"))


@query("SELECT o_custkey, o_orderkey, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def history_depth(spark, d):
    h = read(spark, d, "orders").select(F.col("o_custkey").alias("puuid"), F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("created"))
    return C.newest(h, 5).select(F.col("puuid").alias("o_custkey"), F.col("match_id").alias("o_orderkey"), F.col("place").alias("n"))


@query("WITH i AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT n, o_orderkey IS NOT NULL AS done FROM i LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, count(*) FILTER (WHERE done) AS settled, count(*) FILTER (WHERE NOT done) AS backlog FROM j")
def dedupe_report(spark, d):
    done = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    return C.dedupe_report(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("match_id")), done)


@query("SELECT o_custkey AS puuid, arg_min(o_orderpriority, CASE left(o_orderpriority, 1) WHEN '2' THEN 1 WHEN '1' THEN 2 ELSE 3 END) AS tier FROM orders WHERE left(o_orderpriority, 1) IN ('1', '2') GROUP BY 1")
def ladder_first_tier(spark, d):
    o = read(spark, d, "orders").filter("left(o_orderpriority, 1) in ('1', '2')")
    tiers = ["2", "1"]
    rows = o.select(F.col("o_custkey").alias("puuid"), F.left("o_orderpriority", F.lit(1)).alias("t"), F.col("o_orderpriority").alias("tier"))
    return C.first_tier(rows, tiers, tier="t").select("puuid", "tier")


@query("SELECT o_orderkey, sha256('run-2' || CAST(o_orderkey AS VARCHAR)) AS place FROM orders WHERE o_orderstatus <> 'P' ORDER BY 2 LIMIT 50")
def quota_sample(spark, d):
    got = C.quota(read(spark, d, "orders"), 50, "o_orderkey", "run-2", F.col("o_orderstatus") != "P")
    return got.select("o_orderkey", F.col("order").alias("place"))


@query("WITH h AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS match_id FROM h WHERE n <= 3 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def history_candidates(spark, d):
    h = read(spark, d, "orders").select(F.col("o_custkey").alias("puuid"), F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("created"))
    done = read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("match_id"))
    return C.candidates(h, done, 3).select(F.col("match_id").cast("string").alias("match_id"))


@query("WITH k AS (SELECT event_id, event_id * 7919 % 14990 - 120 AS x, event_id // 28 AS m FROM events) SELECT CAST(greatest(600, max(second)) AS BIGINT) AS longest, count(DISTINCT m) AS games FROM (SELECT m, event_id * 37 % 2400 AS second FROM k)")
def dataset_limits(spark, d):
    return H.limits(facts(spark, d, False))


_TURRETS_XY = _TURRET.replace("pow(x ", "pow(rx ").replace("pow(y ", "pow(ry ")
_REPLAY = f"""WITH e AS (SELECT event_id, event_id // 28 AS m, event_id % 28 AS i, event_type AS k, (event_id % 28 // 2) * 120000 + event_id % 2 * 3000 AS t, (user_id * 3 + event_id % 28) % 10 + 1 AS v, user_id % 10 + 1 AS p, event_id % 18 AS up FROM events),
q AS (SELECT *, CASE WHEN k = 'click' THEN v % 10 + 1 ELSE 0 END AS killer, event_id * 7919 % 14000 AS rx, event_id * 104729 % 14000 AS ry, (m % 7 + 1) * 10 AS step, least(3, t // 420000) AS f FROM e WHERE k IN ('click', 'error')),
o AS (SELECT *, (SELECT arg_max(u.up, u.i) FROM e u WHERE u.m = q.m AND u.k = 'signup' AND u.p = q.v AND u.i < q.i AND u.up > 0) AS level,
    (SELECT count(*) FROM q d WHERE d.m = q.m AND d.v = q.v AND d.i < q.i) AS deaths, (SELECT max(t) FROM q d WHERE d.m = q.m AND d.v = q.v AND d.i < q.i) AS died,
    (SELECT count(*) FROM q d WHERE d.m = q.m AND d.killer = q.killer AND d.i < q.i) AS scored,
    (SELECT max(d.t) FROM e d WHERE d.m = q.m AND d.k = 'purchase' AND d.i < q.i) AS dragon, (SELECT count(*) FROM e d WHERE d.m = q.m AND d.k = 'purchase' AND d.event_id % 5 = 0 AND d.i < q.i) AS elder,
    (SELECT max(d.t) FROM e d WHERE d.m = q.m AND d.k IN ('purchase', 'view') AND d.i < q.i) AS objective,
    (SELECT count(*) FROM q d WHERE d.m = q.m AND d.t <> q.t AND abs(d.t - q.t) <= 5000) AS others, t = min(t) OVER (PARTITION BY m) AS first FROM q),
z AS (SELECT *, (rx + 120) / 14990e0 AS u, (ry + 120) / 15100e0 AS w FROM o)
SELECT 'EU_' || m AS match_id, i // 7 AS frame_index, i % 7 AS event_index, t // 1000 AS second, v AS victim_pid, killer AS killer_pid, CASE WHEN k = 'click' THEN 0 WHEN event_id % 10 > 5 THEN 2 ELSE 1 END AS cause, rx AS x, ry AS y,
    coalesce(level, 1) AS victim_level, least(254, deaths) AS victim_ordinal, CASE WHEN k = 'click' THEN least(254, scored) END AS killer_ordinal, CASE WHEN died IS NOT NULL THEN least(254, (t - died) // 4000) END AS victim_since_prev_death,
    CASE WHEN t >= coalesce(dragon + 300000, 300000) THEN CASE WHEN elder > 0 THEN 8 ELSE 1 END ELSE 0 END + CASE WHEN t >= 1200000 THEN 2 ELSE 0 END + CASE WHEN t >= 840000 AND t < 1500000 THEN 4 ELSE 0 END AS objectives_up,
    CASE WHEN objective IS NOT NULL THEN least(254, (t - objective) // 2000) END AS since_objective, CASE WHEN v > 5 THEN 1 ELSE 2 END + CASE WHEN first THEN 4 ELSE 0 END + CASE WHEN {_TURRETS_XY} THEN 8 ELSE 0 END + CASE WHEN others > 0 THEN 16 ELSE 0 END AS flags,
    -25 * step AS team_gold, CASE WHEN v <= 5 THEN -5 ELSE 5 END * step AS victim_gold_diff_lane, (v - 1) % 5 AS victim_role, 300 + event_id % 200 AS bounty, event_id % 4 AS assists, 'p' || (m * 3 + v) % 40 AS victim_player_id,
    {G.zone_sql("u", "w")} AS region FROM z"""


@query(_REPLAY)
def kill_facts(spark, d):
    columns = ["frame_index", "event_index", "second", "victim_pid", "killer_pid", "cause", "x", "y", "victim_level", "victim_ordinal", "killer_ordinal", "victim_since_prev_death", "objectives_up", "since_objective", "flags", "team_gold", "victim_gold_diff_lane", "victim_role", "bounty", "assists", "region"]
    found = X.kill_facts(*documents(spark, d))
    return found.select("match_id", "victim_player_id", *[F.col(c).cast("long").alias(c) for c in columns])


@query("SELECT event_id // 28 % 2 = 0 AS taken, count(DISTINCT event_id // 28) AS matches FROM events GROUP BY 1")
def document_checks(spark, d):
    matches, lines = documents(spark, d)
    matches = matches.withColumn("m", F.substring_index("metadata.matchId", "_", -1).cast("long"))
    # Every second match gets a player twice.
    twice = F.concat(F.slice("info.participants", 1, 9), F.slice("info.participants", 1, 1))
    matches = matches.withColumn("info", F.when(F.col("m") % 2 == 1, F.col("info").withField("participants", twice)).otherwise(F.col("info")))
    ok = lines.filter(D.timeline_fault().isNull()).select(F.col("metadata.matchId").alias("id"))
    return matches.join(ok, F.col("metadata.matchId") == F.col("id")).groupBy(D.identity_fault().isNull().alias("taken")).agg(F.count(F.lit(1)).alias("matches"))


@query("SELECT event_id // 28 % 6 AS kind, CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN CASE event_id // 28 % 6 WHEN 1 THEN 'order' WHEN 2 THEN 'frame_time' WHEN 3 THEN 'no_frames' ELSE 'event' END END AS fault, event_id // 28 AS match FROM (SELECT *, CASE event_id // 28 % 6 WHEN 0 THEN false WHEN 1 THEN event_id % 28 >= 7 WHEN 2 THEN true WHEN 3 THEN true ELSE event_type IN ('click', 'error') END AS bad FROM events) GROUP BY 1, 3")
def timeline_checks(spark, d):
    """Of six matches one is left as it is; the others get frames in reverse, no frame times, no frames, kills at no place and kills of a player who is not there."""
    _, lines = documents(spark, d)
    m = F.substring_index("metadata.matchId", "_", -1).cast("long")
    f, kind = F.col("info.frames"), m % 6
    kills = lambda change: F.transform(f, lambda x: x.withField("events", F.transform(x["events"], lambda e: F.when(e["type"] == X.KILL, change(e)).otherwise(e))))
    frames = F.when(kind == 1, F.reverse(f)).when(kind == 2, F.transform(f, lambda x: x.withField("timestamp", F.lit(None).cast("long")))).when(kind == 3, F.slice(f, 1, 0))
    frames = frames.when(kind == 4, kills(lambda e: e.withField("position.x", F.lit(float("nan"))))).when(kind == 5, kills(lambda e: e.withField("victimId", F.lit(11)))).otherwise(f)
    return lines.select(kind.alias("kind"), m.alias("match"), F.col("info").withField("frames", frames).alias("info")).select("kind", D.timeline_fault().alias("fault"), "match")


@query("WITH l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT 'o' || o.o_orderkey AS key, CASE WHEN n >= 4 THEN n ELSE CAST(floor(o_totalprice) AS BIGINT) END AS v FROM orders o LEFT JOIN l ON o_orderkey = l_orderkey WHERE NOT (o_orderstatus = 'P' AND coalesce(n, 0) < 6) AND o_orderkey % 10 = 1 AND ('o' || o.o_orderkey) LIKE 'o1%'")
def keyed_state(spark, d):
    """Orders as state by key: all are set, those with four lines and more set again, pending ones deleted, then those with six lines set once more; the base is written anew in between."""
    state = Keyed(spark, files.scratch(spark, "state"), "orders", "v long")
    orders = read(spark, d, "orders").filter("o_orderkey % 10 = 1").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), F.floor("o_totalprice").alias("v"), "o_orderstatus")
    lines = read(spark, d, "lineitem").filter("l_orderkey % 10 = 1").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("key")).agg(F.count(F.lit(1)).alias("v"))
    lines = lines.join(orders.select("key"), "key", "left_semi")
    state.upsert(orders, 1)
    state.upsert(lines.filter("v >= 4"), 2)
    state.compact()
    state.delete(orders.filter("o_orderstatus = 'P'"), 3)
    state.upsert(lines.filter("v >= 6"), 4)
    return state.read(prefix="o1")


@query("WITH k AS (SELECT o_custkey AS c, count(*) AS n, max(o_orderkey) AS last, count(*) FILTER (WHERE o_orderstatus = 'P') AS open FROM orders GROUP BY 1) SELECT coalesce(c_custkey, c) AS player, CASE WHEN c_custkey IS NULL OR c_custkey % 3 = 2 THEN 50 ELSE c_custkey % 3 * 25 END AS scanned_from, greatest(CASE WHEN c_custkey % 3 < 2 THEN c_custkey * 10 END, CASE WHEN open = 0 AND c % 4 <> 1 THEN last END) AS scanned_to FROM (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) FULL JOIN k ON c_custkey = c WHERE coalesce(c_custkey % 3 < 2, false) OR (open = 0 AND c % 4 <> 1)")
def player_marks(spark, d):
    """Marks of players after their pages were read: customers are players, their orders the pages, of one match each; every fourth player's last page is not there."""
    o = read(spark, d, "orders").withColumn("player", F.col("o_custkey"))
    place = F.row_number().over(Window.partitionBy("player").orderBy("o_orderkey")) - 1
    last = F.max("o_orderkey").over(Window.partitionBy("player"))
    pages = o.select("player", last.alias("until"), place.alias("start"), F.lit(1).alias("n"), ((F.col("o_orderkey") == last) & (F.col("o_custkey") % 4 != 1)).alias("done"))
    waiting = o.filter("o_orderstatus = 'P'").groupBy("player").agg(F.count(F.lit(1)).alias("open"))
    told = histories(pages).join(waiting, "player", "left").select("player", "scanned_to", "finished", F.coalesce("open", F.lit(0)).alias("open"))
    old = read(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("player"), (F.col("c_custkey") % 3 * 25 + F.when(F.col("c_custkey") % 3 == 2, 100).otherwise(0)).alias("scanned_from"), (F.col("c_custkey") * 10).alias("scanned_to"))
    return advanced(old, told, 50).select("player", "scanned_from", "scanned_to")


@query(f"WITH r AS ({_REPLAY}) SELECT region, count(*) AS deaths, count(*) FILTER (WHERE cause = 0) AS kills, count(DISTINCT match_id) AS games, (SELECT count(DISTINCT event_id // 28) FROM events) AS matches, (SELECT count(DISTINCT victim_player_id) FROM r) <= 40 AS players FROM r GROUP BY 1")
def release_sql(spark, d):
    """A release of the events' documents, verified, and asked by its id in SQL."""
    matches, lines = documents(spark, d)
    site = files.scratch(spark, "release")
    dims = matches.select(F.col("metadata.matchId").alias("match_id"), D.patch_of(F.col("info.gameVersion")).alias("patch_id"), F.col("info.gameCreation").alias("game_start_ms"), D.seconds().cast("long").alias("seconds"))

    def landed(df, name):
        df.write.parquet(f"{site}/landed/{name}")
        return spark.read.schema(df.schema).parquet(f"{site}/landed/{name}")

    name = R.publish(landed(X.kill_facts(matches, lines), "facts"), landed(dims, "matches"), landed(D.participants(matches), "players"), site, {"schema": 1})
    said = R.verified(spark, site)
    R.register(spark, site)
    rows = spark.sql(f"SELECT CAST(region AS BIGINT) AS region, count(*) AS deaths, count_if(cause = 0) AS kills, count(DISTINCT match) AS games FROM kills_wide_of('{name}') GROUP BY 1")
    return rows.select("*", F.lit(said["matches"]).cast("long").alias("matches"), F.lit(said["players"] <= 40).alias("players"))


@query(f"WITH {K} SELECT event_id % 255 AS tag, x, second, victim_champ, killer_champ, killer_player, count(*) AS n FROM k GROUP BY ALL")
def typed_columns_round_trip(spark, d):
    """Events' facts written as typed columns and read back, nulls with them."""
    path = files.scratch(spark, "columns")
    columns.register(spark)
    own = ["x", "second", "victim_champ", "killer_champ", "killer_player"]
    rows = facts(spark, d, False).select((F.col("event_id") % 255).alias("tag"), *own)
    rows.write.format("typed_columns").option("kinds", "tag:u8,x:i16,second:u16,victim_champ:u16,killer_champ:u8,killer_player:u16").mode("append").save(path)
    back = spark.read.format("typed_columns").load(path)
    return back.select(*[F.col(c).cast("long").alias(c) for c in back.columns]).groupBy("tag", *own).agg(F.count(F.lit(1)).alias("n"))


_V, _O = "victim_champ IN (1, 2, 5) AND victim_champ <> 3 AND victim_player IN (3, 6, 9)", "killer_champ IN (1, 2, 5) AND killer_champ <> 3 AND killer_player IN (3, 6, 9)"


@query(f"{seen_sql(f'{_V} AND coalesce(killer_player <> 10, true)', f'{_O} AND victim_player <> 10', 'cause = 0 AND second BETWEEN 300 AND 1500 AND patch <> 2')} SELECT {cell_sql(64)} AS cell, {AGG} FROM s GROUP BY 1")
def link_filter(spark, d):
    """A link, read, written and read again, then moved to a release whose players and patches have other keys: the counts are those of its facets."""
    link = "layer=kills&s.champ=1,2,!3,5,99&s.player_id=u3&s.player_id=u6&s.player_id=u9&s.player_id=gone&o.exclude_player_id=u10&c.cause=0&c.patch=!7&time=300,1500&assists=9,1&grid=64&other=1"
    state = H.parse_state(link)
    state = H.parse_state(H.state_query(state))
    k = facts(spark, d, False)
    players = k.select(F.col("victim_player").alias("sk")).union(k.select("killer_player")).filter("sk is not null").distinct().select(F.concat(F.lit("u"), F.col("sk").cast("string")).alias("id"), "sk")
    champs = k.select(F.col("victim_champ").alias("sk")).distinct().select(F.col("sk").cast("string").alias("id"), "sk")
    patches = k.select(F.col("patch").alias("sk")).distinct().select(F.concat(F.lit("p"), F.col("sk").cast("string")).alias("id"), "sk")
    before = patches.select("id", (F.col("sk") + 5).alias("sk"))
    state = H.reconciled(state, {"player": players, "champ": champs, "patch": patches}, {"patch": before})
    return H.grid(H.perspectives(k, state), state.grid)


_NEAR = """(SELECT CAST(floor(min(sqrt(pow((x.p - {a}) * 1000, 2) + pow((x.p - {a}) * 900, 2))) FILTER (WHERE x.p <> {a} AND (x.p <= 5) = ({a} <= 5)) / 100) AS BIGINT) FROM al x WHERE x.event_id = q.event_id AND alive)"""
_SURROUNDINGS = f"""WITH e AS (SELECT event_id, event_id // 28 AS m, event_id % 28 AS i, event_type AS k, (event_id % 28 // 2) * 120000 + event_id % 2 * 3000 AS t, (user_id * 3 + event_id % 28) % 10 + 1 AS v, user_id % 10 + 1 AS p, event_id % 18 AS up FROM events),
q AS (SELECT *, CASE WHEN k = 'click' THEN v % 10 + 1 END AS killer FROM e WHERE k IN ('click', 'error')),
d AS (SELECT *, coalesce((SELECT arg_max(u.up, u.i) FROM e u WHERE u.m = q.m AND u.k = 'signup' AND u.p = q.v AND u.i < q.i AND u.up > 0), 1) AS lvl FROM q),
b AS (SELECT m, i, v, t + CAST(floor(list_extract({[float(x) for x in S.RESPAWN]}::DOUBLE[], lvl) * CASE WHEN t < 900000 THEN 1 ELSE 1 + least(0.5e0, (t - 900000) // 300000 * 0.05e0) END * 1000) AS BIGINT) AS back FROM d),
al AS (SELECT q.event_id, r.p, coalesce((SELECT arg_max(b.back, b.i) FROM b WHERE b.m = q.m AND b.v = r.p AND b.i < q.i) <= q.t, true) AS alive FROM q, range(1, 11) r(p))
SELECT 'EU_' || m AS match_id, i // 7 AS frame_index, i % 7 AS event_index, (SELECT count(*) FILTER (WHERE alive AND p <= 5) * 16 + count(*) FILTER (WHERE alive AND p > 5) FROM al WHERE al.event_id = q.event_id) AS alive_counts,
    {_NEAR.format(a="q.v")} AS victim_isolation, (SELECT count(*) FROM al x WHERE x.event_id = q.event_id AND alive AND (x.p <= 5) <> (q.v <= 5) AND abs(x.p - q.v) <= 1) AS victim_enemies_near, CASE WHEN v <= 5 THEN -5 ELSE 5 END AS victim_cs_diff_lane,
    CASE WHEN k = 'click' THEN {_NEAR.format(a="q.killer")} END AS killer_isolation, CASE WHEN killer <= 5 THEN -5 WHEN killer > 5 THEN 5 END AS killer_cs_diff_lane FROM q"""


@query(_SURROUNDINGS)
def kill_surroundings(spark, d):
    """Who is alive at each kill, how far victim and killer are from their nearest living ally, and their farm against their lane opponents."""
    columns = ["frame_index", "event_index", "alive_counts", "victim_isolation", "victim_enemies_near", "victim_cs_diff_lane", "killer_isolation", "killer_cs_diff_lane"]
    found = X.kill_facts(*documents(spark, d))
    return found.select("match_id", *[F.col(c).cast("long").alias(c) for c in columns])


@query("SELECT 'EU_' || event_id // 28 AS match_id, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS kills, 10 AS players, 1800 AS seconds, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS recorded FROM events WHERE event_id // 28 % 5 <> 3 GROUP BY 1")
def committed_matches(spark, d):
    """The events' documents discovered, judged, written, read back, recorded and read as committed; every fifth match has no timeline and stays a candidate."""
    matches, lines = documents(spark, d)
    as_json = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind), F.lit("/"), "metadata.matchId").alias("file"), F.to_json(F.struct("metadata", "info")).alias("text"), F.substring_index("metadata.matchId", "_", -1).cast("long").alias("m"))
    store = I.Store(spark, files.scratch(spark, "store"))
    landed = as_json(matches, "match").unionByName(as_json(lines, "timeline").filter("m % 5 <> 3")).drop("m")
    I.discover(store, landed, 1)
    I.ingest(store, store.candidates(), 2, "run")
    tables = I.committed(store)
    kills = tables["fact_kill"].groupBy("match_id").agg(F.count(F.lit(1)).alias("kills"))
    players = tables["dim_participant"].groupBy("match_id").agg(F.count(F.lit(1)).alias("players"))
    said = store.matches.read().filter("status = 'done'").select(F.col("key").alias("match_id"), F.col("n_rows").alias("recorded"))
    return said.join(tables["dim_match"].select("match_id", "seconds"), "match_id").join(players, "match_id").join(kills, "match_id", "left").select("match_id", F.coalesce("kills", F.lit(0)).alias("kills"), "players", "seconds", "recorded")
