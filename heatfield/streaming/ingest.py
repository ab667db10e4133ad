"""Incremental ingestion: landed documents to candidates, candidates to committed matches.

discover() takes what has landed: documents of matches and timelines, and pages of players' histories. The documents and the
match ids they name are kept as state by key before the pages are, and the stream's own mark moves last, so no crash loses an
id. ingest() takes candidates and judges them, writes their facts and dimensions under a number of the batch that is used once,
reads them back, compares digests with those of what was to be written, and then records the matches: only a recorded match is
there for readers, whatever files a lost batch has left. Settled matches (committed under this schema, or rejected under the
same scope) are never taken again; a match that lacks a document or fails a check stays a candidate. A document that lands again
for an open match takes the earlier one's place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heatfield.operators import collection as C
from heatfield.operators.asof import dealt
from heatfield.operators.facts import MATCHES, kill_facts, out_of_range, unreconciled
from heatfield.sources import documents as D
from heatfield.sources import files
from heatfield.streaming.lease import Lease
from heatfield.streaming.state import DELTAS, KEYS, Keyed

#: kind is the folder that a document landed in: match, timeline or history.
LANDED = "kind string, file string, text string"
#: A page of a player's history: ids from place `start` on, of the window from since to until; the last page is done.
HISTORY = "puuid string, region string, since long, until long, start long, ids array<string>, done boolean"
TABLES = ("fact_kill", "dim_match", "dim_participant")


class IntegrityError(ValueError):
    """Stored rows are not those that were committed."""


@dataclass
class Store:
    """The collector's state under root. Keys: match, open and docs by match id, pages by player, window and place, marks by player."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        of = lambda name, schema, **own: Keyed(self.spark, self.root, name, schema, **own)
        self.matches = of("match", "status string, reason string, schema int, scope string, run string, batch long, n_rows long, digest string")
        self.open = of("open", "player string, status string, reason string, batch long")
        self.docs = of("docs", "match_id string, kind string, file string, text string", each=2 * MATCHES)
        self.pages = of("pages", "player string, since long, until long, start long, n long, done boolean")
        self.marks = of("marks", "scanned_from long, scanned_to long")

    def settled(self, schema: int = 1, scope: str = "") -> DataFrame:
        """match_id of the matches that need no second look."""
        return C.settled(self.matches.read().withColumnRenamed("key", "match_id"), schema, scope)

    def candidates(self, schema: int = 1, scope: str = "") -> DataFrame:
        """match_id, player, status of what is open."""
        return self.open.read().select(F.col("key").alias("match_id"), "player", "status").join(self.settled(schema, scope), "match_id", "left_anti")

    def new_games(self, run: str) -> int:
        return self.matches.read().filter((F.col("status") == "done") & (F.col("run") == run)).count()

    def tidy(self, schema: int = 1, scope: str = "", least: int = DELTAS) -> None:
        """Writes state anew where it has many deltas, without what is settled or behind a player's mark."""
        gone = self.settled(schema, scope)
        self.open.compact(lambda df: df.join(gone.withColumnRenamed("match_id", "key"), "key", "left_anti"), least)
        self.docs.compact(lambda df: df.join(gone, "match_id", "left_anti"), least)
        marks = self.marks.read().select(F.col("key").alias("player"), "scanned_to")
        self.pages.compact(lambda df: df.join(marks, "player", "left").filter("scanned_to is null or until > scanned_to").drop("scanned_to"), least)
        self.matches.compact(least=least)
        self.marks.compact(least=least)


def scope_of(patches: list[str] | None) -> str:
    """A rejection holds as long as the patches that are taken."""
    return ",".join(sorted(patches or []))


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in order."""
    return df.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("r")).select("r.*")


def discover(store: Store, landed: DataFrame, step: int, schema: int = 1, scope: str = "") -> None:
    """Keeps landed(kind, file, text) of matches that are not settled, and what they name. Documents without a match id go to a table of their own."""
    gone = store.settled(schema, scope)
    docs = landed.filter("kind in ('match', 'timeline')").withColumn("match_id", F.get_json_object("text", "$.metadata.matchId"))
    docs.filter("match_id is null").select("kind", "file").write.mode("overwrite").parquet(f"{store.root}/unreadable/step={step}")
    docs = docs.filter("match_id is not null").join(gone, "match_id", "left_anti").withColumn("key", F.concat("match_id", F.lit("#"), "kind"))
    store.docs.upsert(first_of(dealt(docs, landed.count(), 2 * MATCHES, "key"), "key", "file"), step)
    page = landed.filter("kind = 'history'").select(F.from_json("text", HISTORY).alias("p")).select("p.*").filter("puuid is not null")
    page = page.withColumn("player", F.concat(F.coalesce("region", F.lit("")), F.lit("#"), "puuid"))
    named = page.select(F.explode("ids").alias("match_id"), "player").unionByName(store.docs.read().join(docs.select("key"), "key", "left_semi").select("match_id", F.lit(None).cast("string").alias("player")))
    found = named.filter(F.col("match_id").rlike(D.MATCH_ID)).groupBy("match_id").agg(F.min("player").alias("player")).join(gone, "match_id", "left_anti")
    old = store.open.read().select(F.col("key").alias("match_id"), F.col("player").alias("known"))
    found = found.join(old, "match_id", "left").select(F.col("match_id").alias("key"), F.coalesce("known", "player").alias("player"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(step).cast("long").alias("batch"))
    store.open.upsert(found, step)
    start, n = F.coalesce("start", F.lit(0).cast("long")), F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    pages = page.select(F.concat_ws("#", "player", F.coalesce("until", F.lit(0).cast("long")).cast("string"), start.cast("string")).alias("key"), "player", F.coalesce("since", F.lit(0).cast("long")).alias("since"), F.coalesce("until", F.lit(0).cast("long")).alias("until"), start.alias("start"), n.alias("n"), F.coalesce("done", F.lit(False)).alias("done"))
    store.pages.upsert(first_of(pages, "key", "n"), step)


def stream(store: Store, landed: str, lease: Lease, schema: int = 1, scope: str = "") -> StreamingQuery | None:
    """Discovers what has landed under landed/match, landed/timeline and landed/history since the last time, then ends. None if nothing ever landed."""
    spark = store.spark
    if not files.exists(spark, landed):
        return None

    def batch(df: DataFrame, n: int) -> None:
        lease.check()
        path = f"{store.root}/work/landed={n}"
        df.write.mode("overwrite").parquet(path)
        discover(store, spark.read.schema(LANDED).parquet(path), lease.step(), schema, scope)
        files.delete(spark, path)

    file = F.col("_metadata.file_path")
    texts = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(landed)
    texts = texts.select(F.regexp_extract(file, "/([^/]+)/[^/]+$", 1).alias("kind"), file.alias("file"), F.col("value").alias("text"))
    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()


def digests(tables: dict[str, DataFrame]) -> DataFrame:
    """match_id, n_rows (facts), digest of a match's rows in all tables, whatever their order: sums of row hashes."""
    rows = []
    for name, df in tables.items():
        own = F.to_json(F.struct(*sorted(c for c in df.columns if c != "batch")), {"ignoreNullFields": "false"})
        rows.append(df.select("match_id", F.lit(name == "fact_kill").alias("fact"), F.sha2(F.concat(F.lit(f"{name}:"), own), 256).alias("h")))
    every = rows[0]
    for df in rows[1:]:
        every = every.unionByName(df)
    piece = lambda i: F.sum(F.conv(F.substring("h", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = every.groupBy("match_id").agg(F.count_if("fact").alias("n_rows"), *[piece(i).alias(f"s{i}") for i in range(5)])
    return sums.select("match_id", "n_rows", F.sha2(F.concat_ws(",", *[f"s{i}" for i in range(5)]), 256).alias("digest"))


def _kept(store: Store, df: DataFrame, name: str) -> DataFrame:
    path = f"{store.root}/work/{name}"
    df.write.mode("overwrite").parquet(path)
    return store.spark.read.schema(df.schema).parquet(path)


def _judged(store: Store, ids: DataFrame, keys: list[str] | None, patches: list[str] | None) -> DataFrame:
    """Each of ids(match_id) with its documents, rejected (why it is not taken) and reason (why it is not committed); a task has the documents of about MATCHES."""
    docs = store.docs.read(keys=[f"{k}#{kind}" for k in keys for kind in ("match", "timeline")]) if keys is not None else store.docs.read().join(ids.select("match_id"), "match_id", "left_semi")
    n = ids.count()
    deal = lambda df: dealt(df, n, MATCHES, "match_id")
    of = lambda kind, schema: deal(docs.filter(F.col("kind") == kind)).select("match_id", F.from_json("text", schema).alias("d"))
    both = deal(ids.select("match_id")).join(of("match", D.MATCH).select("match_id", "d.*"), "match_id", "left").join(of("timeline", D.TIMELINE).withColumnRenamed("d", "timeline"), "match_id", "left")
    both = both.withColumns({"rejected": F.when(F.col("metadata").isNotNull(), D.rejection(patches)), "fault": D.identity_fault()})
    line_fault = F.when(F.col("timeline").isNotNull(), D.timeline_fault("timeline.info"))
    reason = F.coalesce(F.when(F.col("metadata.matchId").isNull(), "match_404"), "rejected", "fault", F.when(F.col("timeline").isNull(), "timeline_404"), line_fault)
    return both.withColumn("reason", reason)


def ingest(store: Store, ids: DataFrame, step: int, run: str, patches: list[str] | None = None, schema: int = 1) -> None:
    """Commits the good ones of ids(match_id, player). A batch that ends early has committed nothing, or all."""
    root, work = store.root, f"step={step}"
    few = [r.match_id for r in ids.limit(KEYS // 2 + 1).select("match_id").collect()]
    judged = _kept(store, _judged(store, ids, few if len(few) <= KEYS // 2 else None, patches), f"{work}/judged")
    good = judged.filter("reason is null")
    docs, lines = good.select("metadata", "info"), good.select("timeline.metadata", "timeline.info")
    facts = _kept(store, kill_facts(docs, lines), f"{work}/facts")
    odd = unreconciled(facts, docs, lines).select("match_id", F.lit("kills").alias("why"))
    wrong = odd.unionByName(out_of_range(facts).select("match_id", F.lit("range").alias("why"))).groupBy("match_id").agg(F.min("why").alias("why"))
    wrong = _kept(store, wrong, f"{work}/wrong")
    judged = judged.join(wrong, "match_id", "left").withColumn("reason", F.coalesce("reason", "why"))
    good = judged.filter("reason is null")
    docs = good.select("metadata", "info")
    started = F.coalesce("info.gameStartTimestamp", "info.gameCreation")
    made = {
        "fact_kill": facts.join(wrong, "match_id", "left_anti"), "dim_participant": D.participants(docs),
        "dim_match": good.select("match_id", D.patch_of(F.col("info.gameVersion")).alias("patch_id"), started.alias("game_start_ms"), D.seconds().cast("long").alias("seconds")),
    }
    said = _kept(store, digests(made), f"{work}/digests")
    for name, df in made.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={step}")
    back = {name: store.spark.read.schema(df.schema).parquet(f"{root}/{name}/batch={step}") for name, df in made.items()}
    _compared(said, digests(back))
    told = judged.select("match_id", "rejected", "reason").join(said, "match_id", "left")
    status = F.when(F.col("reason").isNull(), "done").when(F.col("rejected").isNotNull(), "rejected").otherwise("error")
    told = told.select(F.col("match_id").alias("key"), status.alias("status"), "reason", F.lit(schema).alias("schema"), F.lit(scope_of(patches)).alias("scope"), F.lit(run).alias("run"), F.lit(step).cast("long").alias("batch"), "n_rows", "digest")
    told = _kept(store, told, f"{work}/told")
    store.matches.upsert(told.filter("status <> 'error'"), step)  # the commit
    failed = told.filter("status = 'error'").join(ids.select(F.col("match_id").alias("key"), "player"), "key").select("key", "player", "status", "reason", "batch")
    store.open.upsert(failed, step)
    files.delete(store.spark, f"{root}/work/{work}")


def _compared(said: DataFrame, found: DataFrame) -> None:
    """An error unless both have the same digests."""
    both = said.select("match_id", F.col("digest").alias("said")).join(found.select("match_id", F.col("digest").alias("found")), "match_id", "full_outer")
    if bad := both.filter(~F.col("said").eqNullSafe(F.col("found"))).limit(3).collect():
        raise IntegrityError(f"stored rows are not those that were committed: {sorted(r.match_id for r in bad)}")


def committed(store: Store, check: bool = True) -> dict[str, DataFrame] | None:
    """The committed matches' rows of each of TABLES, without those of lost batches; None if there is none. With check, an IntegrityError unless they have the digests of their commit."""
    done = store.matches.read().filter("status = 'done'").select(F.col("key").alias("match_id"), "batch", "digest")
    if done.isEmpty():
        return None
    read = {name: store.spark.read.parquet(f"{store.root}/{name}").join(done.select("match_id", "batch"), ["match_id", "batch"], "left_semi").drop("batch") for name in TABLES}
    if check:
        _compared(done, digests(read))
    return read


def advanced(marks: DataFrame, histories: DataFrame, floor_ms: int, unsettled: DataFrame | None = None) -> DataFrame:
    """New watermarks(player, scanned_from, scanned_to) from histories(player, scanned_to, finished, open). A mark moves only if its history was read to the end and no match of it is open; a mark that starts above the floor is ignored.

    unsettled(match_id, player): one of an unknown player may be anybody's, and keeps all marks as they are.
    """
    if unsettled is not None and not unsettled.filter("player is null").isEmpty():
        return marks.select("player", "scanned_from", "scanned_to")
    ok = histories.filter("finished and open = 0").select("player", F.col("scanned_to").alias("to"))
    old = marks.filter(F.col("scanned_from") <= floor_ms)
    joined = old.join(ok, "player", "full_outer")
    return joined.select("player", F.coalesce("scanned_from", F.lit(floor_ms)).alias("scanned_from"), F.greatest("scanned_to", "to").alias("scanned_to"))


def since(mark_from: Column, mark_to: Column, floor: int) -> Column:
    """From when a player's history is to be listed: a mark that starts above the floor does not count."""
    return F.when(mark_from > floor, F.lit(floor)).otherwise(F.greatest(F.lit(floor), F.coalesce(mark_to, F.lit(floor))))


def histories(pages: DataFrame) -> DataFrame:
    """player, scanned_to, finished of each window of pages: it is read to the end if its last page is there and all places before it are."""
    w = pages.groupBy("player", "until").agg(F.sum("n").alias("n"), F.max(F.when(F.col("done"), F.col("start") + F.col("n"))).alias("end"))
    return w.select("player", F.col("until").alias("scanned_to"), F.coalesce(F.col("n") >= F.col("end"), F.lit(False)).alias("finished"))


def advance(store: Store, step: int, floor: int = 0, schema: int = 1, scope: str = "") -> None:
    """Moves the marks of players whose windows are read to the end and all of whose matches are settled."""
    unsettled = store.candidates(schema, scope)
    left = unsettled.groupBy("player").agg(F.count(F.lit(1)).alias("open"))
    seen = histories(store.pages.read())
    last = seen.filter("finished").groupBy("player").agg(F.max("scanned_to").alias("scanned_to"), F.lit(True).alias("finished"))
    told = last.join(left, "player", "left").select("player", "scanned_to", "finished", F.coalesce("open", F.lit(0)).alias("open"))
    old = store.marks.read().select(F.col("key").alias("player"), "scanned_from", "scanned_to")
    new = advanced(old, told, floor, unsettled)
    moved = new.join(old, ["player", "scanned_from", "scanned_to"], "left_anti").filter("scanned_to is not null")
    store.marks.upsert(moved.select(F.col("player").alias("key"), "scanned_from", "scanned_to"), step)
