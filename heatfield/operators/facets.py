"""The map algebra: facets to a predicate, perspectives, grids, zones, ratios, smoothing and top zones.

A fact has x, y, side (bit 0 of flags: the victim is red), second, team_gold, assists, region, cause, patch, match and,
for victim and killer, champ, role, player and lane_gold; a null stands for unknown.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatfield.functions import geometry as G

#: Prior events, least events of a shown cell, thin slices, density of a grid, kernel of the smoothing.
PRIOR, LEAST, THIN, DENSITY = 10.0, 5, 200, 0.6
KERNEL = [0.0276, 0.0663, 0.1238, 0.1802, 0.2042, 0.1802, 0.1238, 0.0663, 0.0276]
LAYERS = ("deaths", "kills", "danger", "opportunity")
SCALES = ("lin", "sqrt", "log")
#: Least and most of each range.
RANGES = {"time": (0, 86_400), "gold": (-25_000, 25_000), "lanegold": (-10_000, 10_000), "assists": (0, 9)}
FIELDS = {"time": "time", "gold": "team_gold", "lanegold": "lane_gold", "assists": "assists"}
Facet = Sequence[tuple[int, bool]]  # value, and whether it is excluded


@dataclass(frozen=True)
class Actor:
    """Whom a state asks for. player holds keys of the release; player_id holds stable ids, which reconciled() turns into keys."""

    champ: Facet = ()
    role: Facet = ()
    player: Facet = ()
    side: Facet = ()
    player_id: tuple[tuple[str, bool], ...] = ()


@dataclass(frozen=True)
class State:
    layer: str = "deaths"
    subject: Actor = field(default_factory=Actor)
    opponent: Actor = field(default_factory=Actor)
    region: Facet = ()
    cause: Facet = ()
    patch: Facet = ()
    time: tuple[int, int] | None = None
    team_gold: tuple[int, int] | None = None
    assists: tuple[int, int] | None = None
    lane_gold: tuple[int, int] | None = None
    grid: int | None = None
    scale: str = "lin"
    smooth: bool = True


def facet(c: Column, entries: Facet) -> Column:
    """An excluded value never passes; without included values all others do. An unknown value is no match of either."""
    gone, want = [v for v, x in entries if x], [v for v, x in entries if not x]
    ok = F.lit(True)
    if gone:
        ok = ok & ~F.coalesce(c.isin(gone), F.lit(False))
    if want:
        ok = ok & F.coalesce(c.isin(want), F.lit(False))
    return ok


def between(c: Column, span: tuple[int, int] | None) -> Column:
    return F.lit(True) if span is None else F.coalesce(c.between(*span), F.lit(False))


def actor(who: str, want: Actor) -> Column:
    red = F.col("flags").bitwiseAND(1) == 1
    side = F.when(red, 200).otherwise(100)
    own = side if who == "victim" else 300 - side
    if want.player_id and not want.player:
        raise ValueError("player ids have to be turned into a release's keys by reconciled() first")
    tests = [facet(F.col(f"{who}_{c}"), getattr(want, c)) for c in ("champ", "role", "player")]
    return reduce(lambda a, b: a & b, [*tests, facet(own, want.side)])


def perspectives(facts: DataFrame, state: State) -> DataFrame:
    """Facts that match, with as_victim and as_killer: the subject died, or killed a champion."""
    common = between(F.col("second"), state.time) & between(F.col("team_gold"), state.team_gold) & between(F.col("assists"), state.assists)
    common = common & facet(F.col("region"), state.region) & facet(F.col("cause"), state.cause) & facet(F.col("patch"), state.patch)
    v = actor("victim", state.subject) & actor("killer", state.opponent) & between(F.col("victim_lane_gold"), state.lane_gold)
    k = (F.col("cause") == 0) & actor("killer", state.subject) & actor("victim", state.opponent) & between(F.col("killer_lane_gold"), state.lane_gold)
    return facts.filter(common & (v | k)).withColumns({"as_victim": v, "as_killer": k})


def by_match(seen: DataFrame, *by: Column) -> DataFrame:
    """deaths and kills of each match, apart by the given columns."""
    return seen.groupBy(*by, F.col("match")).agg(F.count_if("as_victim").alias("deaths"), F.count_if("as_killer").alias("kills"))


def _rolled(matches: DataFrame, *by: str) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    game = lambda c: F.count_if(c & F.col("match").isNotNull())
    return matches.groupBy(*by).agg(n("deaths"), n("kills"), game(F.col("deaths") > 0).alias("death_games"), game(F.col("kills") > 0).alias("kill_games"), game(F.lit(True)).alias("games"))


def counts(seen: DataFrame, *by: Column) -> DataFrame:
    """deaths, kills and distinct games of the deaths, the kills and both. Matches are added up first, so that no row is copied for each distinct count."""
    matches = by_match(seen, *by)
    return _rolled(matches, *matches.columns[: len(by)])


def grid(seen: DataFrame, size: int) -> DataFrame:
    return counts(seen, G.cell_of(F.col("x"), F.col("y"), size).alias("cell"))


def by_zone(seen: DataFrame) -> DataFrame:
    return counts(seen, F.col("region"))


def totals(seen: DataFrame) -> DataFrame:
    return counts(seen)


def danger(deaths: Column, kills: Column, scale: float = 1.0) -> Column:
    """Share of deaths with PRIOR even events added; null below LEAST events. scale: events that one unit of a smoothed count stands for."""
    n = (deaths + kills) * scale
    return F.when(n >= LEAST, (deaths * scale + PRIOR / 2) / (n + PRIOR))


def layer(cells: DataFrame, name: str, scale: float = 1.0) -> DataFrame:
    """cells with value: a share of the total for counts, a ratio for danger and opportunity."""
    if name in ("deaths", "kills"):
        total = F.sum(name).over(Window.partitionBy())
        return cells.withColumn("value", F.when(total > 0, F.col(name) / total))
    d = danger(F.col("deaths"), F.col("kills"), scale)
    return cells.withColumn("value", d if name == "danger" else 1 - d)


def index_percentile(values: DataFrame, c: str, p: float, last: bool = False) -> DataFrame:
    """One row: the positive value at index floor(n p), or floor((n - 1) p) with last, of the sorted ones, never between two. Values are counted before they are ranked, so the sort sees each distinct value once."""
    n = values.filter(F.col(c) > 0).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("v"))
    total = F.sum("n").over(Window.partitionBy())
    at = F.floor((total - 1) * p) if last else F.least(total - 1, F.floor(total * p))
    return n.select("v", upto.alias("upto"), at.alias("at")).filter("upto > at").agg(F.min("v").alias(c))


def spread(cells: DataFrame) -> DataFrame:
    """How far ratios lie from even: the 98th index percentile of |value - 0.5|, 0.02 at least."""
    far = index_percentile(cells.filter("value is not null").select(F.abs(F.col("value") - 0.5).alias("spread")), "spread", 0.98, last=True)
    return far.select(F.greatest(F.coalesce("spread", F.lit(0.0)), F.lit(0.02)).alias("spread"))


def blurred(cells: DataFrame, size: int, columns: Sequence[str] = ("deaths", "kills")) -> DataFrame:
    """Counts smoothed along x, then y, by KERNEL; nothing outside the grid and no renormalising. Each count is spread over its neighbours, so work follows the filled cells."""
    half = len(KERNEL) // 2
    steps = F.explode(F.array(*[F.struct(F.lit(i - half).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(KERNEL)])).alias("k")
    out = cells.select((F.col("cell") % size).alias("bx"), F.floor(F.col("cell") / size).cast("int").alias("by"), *[F.col(c).cast("double").alias(c) for c in columns])
    for axis, other in (("bx", "by"), ("by", "bx")):
        spread_out = out.select("*", steps).select((F.col(axis) + F.col("k.d")).alias(axis), other, *[(F.col(c) * F.col("k.w")).alias(c) for c in columns])
        out = spread_out.filter(F.col(axis).between(0, size - 1)).groupBy("bx", "by").agg(*[F.sum(c).alias(c) for c in columns])
    return out.select((F.col("by") * size + F.col("bx")).alias("cell"), *columns)


def evidence() -> float:
    """Events that a smoothed count of one stands for."""
    return 1 / sum(w * w for w in KERNEL) ** 2


def auto_size(ratio: bool, n: int) -> int:
    if ratio:
        return next((s for s in G.GRIDS if n / s**2 >= DENSITY), 32)
    return 32 if n < 50 else 64 if n < THIN else 128


def auto_grid(seen: DataFrame, state: State) -> DataFrame:
    """grid() at the finest size that the number of events fills, with size. The facts are read once: the size is chosen on the finest cells' counts, which are then made coarser."""
    fine = G.GRIDS[0]
    matches = by_match(seen, G.cell_of(F.col("x"), F.col("y"), fine).alias("cell"))
    ratio = state.layer not in ("deaths", "kills")
    n = F.coalesce(F.sum(F.col("deaths") + F.col("kills") if ratio else F.col(state.layer)), F.lit(0))
    if state.grid:
        size = F.lit(state.grid)
    elif ratio:
        size = F.coalesce(*[F.when(n / s**2 >= DENSITY, s) for s in G.GRIDS], F.lit(G.GRIDS[-1]))
    else:
        size = F.when(n < 50, 32).when(n < THIN, 64).otherwise(128)
    sized = matches.crossJoin(F.broadcast(matches.agg(size.alias("size"))))  # one row
    cell = reduce(lambda out, s: F.when(F.col("size") == s, G.coarser(F.col("cell"), fine, s)).otherwise(out), G.GRIDS, F.col("cell"))
    merged = sized.groupBy(cell.alias("cell"), "size", "match").agg(F.sum("deaths").alias("deaths"), F.sum("kills").alias("kills"))
    return _rolled(merged, "cell", "size").select("cell", "deaths", "kills", "death_games", "kill_games", "games", "size")


def zone_summary(seen: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """Zones with a positive value, greatest first, then by events; rank says the place."""
    rows = layer(by_zone(seen), name).withColumn("n", {"deaths": F.col("deaths"), "kills": F.col("kills")}.get(name, F.col("deaths") + F.col("kills"))).filter("value > 0")
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("value"), F.desc("n"), "region")))  # a zone a row
    return rows.filter(F.col("rank") <= top) if top else rows


def playback(seen: DataFrame, width: int = 240, step: int = 20) -> DataFrame:
    """Counts of every window of `width` seconds that starts at a multiple of `step`."""
    first = F.greatest(F.lit(0), F.ceil((F.col("second") - width + 1) / step))
    starts = F.sequence(first.cast("long"), F.floor(F.col("second") / step).cast("long"))
    return seen.select("*", F.explode(starts).alias("k")).groupBy((F.col("k") * step).alias("start")).agg(F.count_if("as_victim").alias("deaths"), F.count_if("as_killer").alias("kills"))


def limits(facts: DataFrame) -> DataFrame:
    """One row: the last second to choose from, 600 at least, and the number of games."""
    return facts.agg(F.greatest(F.lit(600), F.max("second")).cast("long").alias("longest"), F.count_distinct("match").alias("games"))


def parse_state(query: str) -> State:
    """A link's query string as a state. Words and numbers that are not known fall away, a range in the wrong order does too, others are clamped to RANGES."""
    q: dict[str, list[str]] = {}
    for key, value in parse_qsl(query.lstrip("?"), keep_blank_values=True):
        q.setdefault(key, []).append(value)
    one = lambda key: q.get(key, [""])[0]
    choice = lambda key, known, other: one(key) if one(key) in known else other

    def entries(key: str) -> Facet:
        found = (re.fullmatch(r"(!?)([0-9]+)", x) for x in one(key).split(","))
        return tuple((int(m[2]), m[1] == "!") for m in found if m and int(m[2]) < 1 << 53)

    def span(key: str) -> tuple[int, int] | None:
        parts = one(key).split(",")
        try:
            lo, hi = (float(x) if x.strip() else 0.0 for x in parts)
        except ValueError:
            return None
        if not (math.isfinite(lo) and math.isfinite(hi) and lo <= hi):
            return None
        least, most = RANGES[key]
        lo, hi = (min(most, max(least, x)) for x in (lo, hi))
        return tuple(int(x) if x == int(x) else x for x in (lo, hi))

    def who(p: str) -> Actor:
        ids = tuple((x, out) for key, out in ((f"{p}.player_id", False), (f"{p}.exclude_player_id", True)) for x in q.get(key, []) if re.fullmatch(r"[A-Za-z0-9_-]{1,256}", x))
        return Actor(entries(f"{p}.champ"), entries(f"{p}.role"), (), entries("s.side") if p == "s" else (), ids)

    size = choice("grid", [str(g) for g in G.GRIDS], "")
    spans = {FIELDS[key]: span(key) for key in RANGES}
    return State(choice("layer", LAYERS, "deaths"), who("s"), who("o"), *(entries(f"c.{c}") for c in ("region", "cause", "patch")), **spans, grid=int(size) if size else None, scale=choice("scale", SCALES, "lin"), smooth=one("smooth") != "0")


def state_query(state: State) -> str:
    """The canonical query string; parse_state gives the state back, but for players' keys, which hold for one release only."""
    out = [("layer", state.layer)]
    for p, a in (("s", state.subject), ("o", state.opponent)):
        out += [(f"{p}.{c}", _join(getattr(a, c))) for c in ("role", "champ") if getattr(a, c)]
        out += [(f"{p}.{'exclude_player_id' if x else 'player_id'}", v) for v, x in a.player_id]
        out += [(f"{p}.side", _join(a.side))] if a.side else []
    out += [(f"c.{c}", _join(getattr(state, c))) for c in ("region", "cause", "patch") if getattr(state, c)]
    out += [(key, ",".join(map(str, getattr(state, f)))) for key, f in FIELDS.items() if getattr(state, f)]
    out += [("grid", str(state.grid))] if state.grid else []
    out += [("scale", state.scale)] if state.scale != "lin" else []
    return urlencode(out + ([] if state.smooth else [("smooth", "0")]))


def _join(entries: Facet) -> str:
    return ",".join(f"{'!' if x else ''}{v}" for v, x in entries)


#: Keys that hold in every release.
STABLE = {"role": range(5), "cause": range(5), "side": (100, 200)}


def reconciled(state: State, new: dict[str, DataFrame], old: dict[str, DataFrame] | None = None) -> State:
    """The state with all keys of the new release, whose dimensions new[facet](id, sk) are: patches and regions move by identity
    from the old release's dimensions, players by their stable ids, or else theirs; what the new release lacks falls away,
    champions and fixed keys too. Only the few selected entries are looked up."""

    def pick(df: DataFrame, c: str, values: list) -> list:
        return df.filter(F.col(c).isin(values)).select("id", "sk").collect() if values else []

    def moved(facet_name: str, entries: Facet) -> Facet:
        if facet_name in STABLE:
            return tuple(e for e in entries if e[0] in STABLE[facet_name])
        dim, keys = new.get(facet_name), [v for v, _ in entries]
        if dim is None or not keys:
            return entries if dim is None else ()
        if facet_name == "champ" or not old or facet_name not in old:
            there = {r.sk for r in pick(dim, "sk", keys)}
            return tuple(e for e in entries if e[0] in there)
        ids = {r.sk: r.id for r in pick(old[facet_name], "sk", keys)}
        to = {r.id: r.sk for r in pick(dim, "id", list(ids.values()))}
        return tuple((to[ids[v]], x) for v, x in entries if ids.get(v) in to)

    def players(a: Actor) -> Actor:
        known = {i for i, _ in a.player_id}
        ids = list(a.player_id)
        if old and "player" in old:
            names = {r.sk: r.id for r in pick(old["player"], "sk", [v for v, _ in a.player])}
            ids += [(names[v], x) for v, x in a.player if v in names and names[v] not in known]
        to = {r.id: r.sk for r in pick(new["player"], "id", [i for i, _ in ids])} if "player" in new else {}
        return replace(a, player=tuple((to[i], x) for i, x in ids if i in to), player_id=tuple(e for e in ids if e[0] in to))

    actors = [replace(players(a), **{c: moved(c, getattr(a, c)) for c in ("champ", "role", "side")}) for a in (state.subject, state.opponent)]
    return replace(state, subject=actors[0], opponent=actors[1], **{c: moved(c, getattr(state, c)) for c in ("region", "cause", "patch")})
