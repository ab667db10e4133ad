"""State by key as Parquet: a base that is cut by key ranges, and deltas that are merged when it is read.

A generation's base is sorted by key and has one folder a range, and an index of the ranges' least and greatest keys, so reading a
prefix or a few keys lists only the folders that may hold them. A write adds a delta under its step; of a key's rows that of the
greatest step counts. Steps grow: one that is written again replaces itself, and one that a base has merged already is left out,
so it cannot bring back what was deleted since. Deltas count once their write has committed.

compact() writes a new generation, switches to it by a pointer that is created once, and deletes the old one last: wherever
it stops, the rows are there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatfield.operators.asof import dealt
from heatfield.sources import files

#: Deltas after which a base is written anew; keys that a read names at most.
DELTAS, KEYS = 8, 4096
_OWN = "_step long, _gone boolean"
#: Rows that a task merges, where they are narrow.
EACH = 200_000
#: Most rows of deltas whose keys are broadcast to the base.
CHANGED = 200_000


def _latest(rows: DataFrame, each: int) -> DataFrame:
    """Of each key's rows that of the greatest step; a task has about `each` rows."""
    return dealt(rows, rows.count(), each, "key").groupBy("key").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "key"]), "_step").alias("r")).select("key", "r.*")


class Keyed:
    """Rows of key and `schema` under root/name. One writer at a time. A task merges about `each` rows."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, each: int = EACH):
        self.spark, self.root, self.schema, self.each = spark, f"{root}/state/{name}", f"key string, {schema}", each

    def generation(self) -> int:
        return int(max(files.names(self.spark, f"{self.root}/current"), default="0"))

    def _at(self, generation: int) -> str:
        return f"{self.root}/gen={generation:09d}"

    def deltas(self, generation: int | None = None) -> list[str]:
        folder = f"{self._at(self.generation() if generation is None else generation)}/delta"
        return [f"{folder}/{n}" for n in files.names(self.spark, folder) if files.exists(self.spark, f"{folder}/{n}/_SUCCESS")]

    def merged(self) -> int:
        """The greatest step that the base holds."""
        generation = self.generation()
        return int(files.read(self.spark, f"{self.root}/current/{generation:09d}")) if generation else -1

    def _delta(self, rows: DataFrame, step: int) -> None:
        if step <= self.merged():
            return
        rows.write.mode("overwrite").parquet(f"{self._at(self.generation())}/delta/{step:018d}")

    def upsert(self, rows: DataFrame, step: int) -> None:
        """Sets rows(key, ...), one a key."""
        columns = [c.name for c in self.empty().schema]
        self._delta(rows.select(*columns, F.lit(step).cast("long").alias("_step"), F.lit(False).alias("_gone")), step)

    def delete(self, keys: DataFrame, step: int) -> None:
        """Removes the rows of keys(key)."""
        rest = [F.lit(None).cast(c.dataType).alias(c.name) for c in self.empty().schema if c.name != "key"]
        self._delta(keys.select("key", *rest, F.lit(step).cast("long").alias("_step"), F.lit(True).alias("_gone")), step)

    def empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _parts(self, at: str, prefix: str, keys: Sequence[str] | None) -> list[int]:
        """The base's ranges that may hold a key: the index has a row a range."""
        ranges = self.spark.read.schema("part int, low string, high string").parquet(f"{at}/index").collect()
        hit = lambda r, least, most: r.high >= least and r.low <= most
        asked = [(k, k) for k in keys] if keys is not None else [(prefix, prefix + "\U0010ffff")]
        return [r.part for r in ranges if any(hit(r, *a) for a in asked)]

    def rows(self, prefix: str = "", keys: Sequence[str] | None = None) -> DataFrame:
        """Current rows, those of deleted keys with _gone among them."""
        if keys is not None and len(keys) > KEYS:
            raise ValueError(f"more than {KEYS} keys: join with rows() instead")
        generation = self.generation()
        at, found, schema = self._at(generation), [], f"{self.schema}, {_OWN}"
        wanted = F.col("key").isin(list(keys)) if keys is not None else F.col("key").startswith(prefix)
        if generation:
            base = self.spark.read.schema(f"{schema}, part int").parquet(f"{at}/base")
            if prefix or keys is not None:
                base = base.filter(F.col("part").isin(self._parts(at, prefix, keys)))
            found.append(base.drop("part"))
        if deltas := self.deltas(generation):
            found.append(self.spark.read.schema(schema).parquet(*deltas))
        if not found:
            return self.spark.createDataFrame([], schema)
        if prefix or keys is not None:
            found = [df.filter(wanted) for df in found]
        if len(found) == 1:
            return found[0] if generation else _latest(found[0], self.each)
        base, changes = found
        if changes.limit(CHANGED + 1).count() > CHANGED:
            return _latest(base.unionByName(changes), self.each)
        # Few keys have changed: only their rows are merged, the base's other rows stay where they are.
        keys = F.broadcast(changes.select("key").distinct())
        return base.join(keys, "key", "left_anti").unionByName(_latest(base.join(keys, "key", "left_semi").unionByName(changes), self.each))

    def read(self, prefix: str = "", keys: Sequence[str] | None = None) -> DataFrame:
        return self.rows(prefix, keys).filter("not _gone").drop("_step", "_gone")

    def compact(self, change: Callable[[DataFrame], DataFrame] | None = None, least: int = 0) -> bool:
        """A new generation of the rows (of change(rows)), if there are more than `least` deltas. Returns whether one was written."""
        old = self.generation()
        if len(self.deltas(old)) <= least:
            return False
        last = max([self.merged(), *(int(p.rpartition("/")[2]) for p in self.deltas(old))])
        at, rows = self._at(old + 1), self.rows().filter("not _gone")
        rows = change(rows) if change else rows
        ordered = rows.repartitionByRange("key").withColumn("part", F.spark_partition_id()).sortWithinPartitions("part", "key")
        ordered.write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{at}/base")
        base = self.spark.read.schema(f"{self.schema}, {_OWN}, part int").parquet(f"{at}/base")
        base.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).write.mode("overwrite").parquet(f"{at}/index")
        self._switch(old + 1, last)
        return True

    def _switch(self, new: int, last: int) -> None:
        if not files.create(self.spark, f"{self.root}/current/{new:09d}", str(last)):
            raise FileExistsError(f"{self.root} has another writer")
        for name in files.names(self.spark, self.root):
            if name.startswith("gen=") and int(name[4:]) < new:
                files.delete(self.spark, f"{self.root}/{name}")
        for name in files.names(self.spark, f"{self.root}/current"):
            if int(name) < new:
                files.delete(self.spark, f"{self.root}/current/{name}")
