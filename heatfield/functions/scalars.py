"""Quantising, formatting and text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds to respawn by level, roles, causes and bits.
RESPAWN = [10, 10, 12, 12, 14, 16, 20, 21, 22, 24, 26, 28, 30, 32.5, 35, 37.5, 40, 42.5, 45, 47.5]
ROLES = ["TOP", "JUNGLE", "MIDDLE", "BOTTOM", "UTILITY"]
CHAMPION, TURRET, MINION, MONSTER, UNKNOWN = range(5)
RED, WON, FIRST_BLOOD, UNDER_TURRET, TRADE, IMPUTED = (1 << i for i in range(6))
DRAGON, BARON, HERALD, ELDER = (1 << i for i in range(4))
PHASES = [("0-8", 0, 8), ("8-14", 8, 14), ("14-20", 14, 20), ("20-30", 20, 30), ("30+", 30, 10_000)]


def u8(v: Column, step: float = 1) -> Column:
    """floor(v / step) within 0 to 254; null stays null."""
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(254), F.floor(v / step)))).cast("int")


def i16(v: Column) -> Column:
    return F.when(v.isNotNull(), F.greatest(F.lit(-32767), F.least(F.lit(32767), v))).cast("int")


def respawn_seconds(level: Column, minute: Column) -> Column:
    base = F.element_at(F.array(*[F.lit(float(x)) for x in RESPAWN]), F.greatest(F.lit(1), F.least(F.lit(20), level)).cast("int"))
    late = F.least(F.lit(0.5), F.floor((minute - 15) / 5) * 0.05)
    return F.when(minute < 15, base).otherwise(base * (1 + late))


def phase(minute: Column) -> Column:
    out = None
    for name, lo, hi in PHASES:
        hit = (minute >= lo) & (minute < hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(PHASES[-1][0])


def patch_of(version: Column) -> Column:
    return F.substring_index(version, ".", 2)


def player_name(shown: Column) -> Column:
    """What stands before the last #, if that is not the first character."""
    return F.when(shown.rlike("^.+#"), F.regexp_extract(shown, "^(?s)(.+)#[^#]*$", 1)).otherwise(shown)


def player_tag(shown: Column) -> Column:
    return F.when(shown.rlike("^.+#"), F.substring_index(shown, "#", -1)).otherwise("")


def minutes_seconds(s: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), (s % 60).cast("long"))


def kilo_gold(g: Column) -> Column:
    return F.concat(F.when(g > 0, "+").when(g < 0, "-").otherwise(""), F.format_string("%.1fk", F.abs(g) / 1000.0))


def scaled(t: Column, how: str) -> Column:
    """A layer value from 0 to 1 on a linear, root or log scale."""
    return {"lin": t, "sqrt": F.sqrt(t), "log": F.log1p(9 * t) / F.log(F.lit(10.0))}[how]


#: What players type for a name.
ALIASES = {"kai'sa": "kaisa", "kaisa": "kai'sa", "nunu & willump": "nunu", "j4": "jarvan iv", "asol": "aurelion sol", "mundo": "dr. mundo", "kha": "kha'zix", "vel": "vel'koz", "cho": "cho'gath", "rek": "rek'sai", "mf": "miss fortune", "tf": "twisted fate", "ww": "warwick", "yi": "master yi", "lb": "leblanc", "gp": "gangplank", "ez": "ezreal", "sett": "sett"}


def normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9#]", "")


def fuzzy_score(query: str, label: Column, full: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """How a label answers a search, or null: 0 it, its full form or the query's alias is equal but for case; then on letters,
    digits and # alone: 1 prefix, 2 contained or prefix of the full form, 3 its letters in order within the full form. An empty query takes all labels alike."""
    q = query.strip().lower()
    if not q:
        return F.lit(0)
    full = label if full is None else full
    plain = "".join(c for c in q if c.isascii() and (c.isalnum() or c == "#"))
    exact = F.lower(label).isin([q, *([aliases[q]] if aliases and q in aliases else [])]) | (F.lower(full) == q)
    n, nf = normal(label), normal(full)
    return F.when(exact, 0).when(n.startswith(plain), 1).when(n.contains(plain) | nf.startswith(plain), 2).when(nf.rlike(".*".join(plain)), 3).cast("int")


def search(items: DataFrame, query: str, label: str, full: str | None = None, most: int = 60, aliases: dict[str, str] | None = None) -> DataFrame:
    """The best `most` items for a query, with score: by score, then length of the label, then label."""
    scored = items.withColumn("score", fuzzy_score(query, F.col(label), F.col(full) if full else None, aliases))
    return scored.filter("score is not null").orderBy("score", F.length(label), label).limit(most)
