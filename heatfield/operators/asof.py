"""As-of and interval helpers over union and window: one shuffle on the key, no nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, payload: str, first_if_none: bool = False) -> DataFrame:
    """left with the struct `payload`: the right row of the same key with the greatest `at` not above the left row's.

    first_if_none gives left rows before every right row the first one. Right rows carry all their columns in one
    struct that is never null, so a null inside them is not skipped.
    """
    own = [c for c in right.columns if c not in by]
    r = right.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*own).alias(payload))
    rows = r.unionByName(left.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_left")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(payload, ignorenulls=True).over(w)
    if first_if_none:
        found = F.coalesce(found, F.first(payload, ignorenulls=True).over(Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn(payload, found).filter("_side = 1").select("_left.*", payload)


def others_within(by: Sequence[str], at: Column, reach: int) -> Column:
    """Whether another row of the key lies within reach of `at`, but not at the same value."""
    w = Window.partitionBy(*by).orderBy(at)
    return F.count(F.lit(1)).over(w.rangeBetween(-reach, reach)) > F.count(F.lit(1)).over(w.rangeBetween(0, 0))


def prior(by: Sequence[str], *order: str) -> Window:
    """All rows before this one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def dealt(rows: DataFrame, n: int, each: int, *by: str) -> DataFrame:
    """rows dealt by hash of `by`, in partitions of about `each` of the n keys or rows: adaptive execution merges none of a number
    that is said, so what a task holds at once does not grow with the input."""
    return rows.repartition(max(1, -(-n // each)), *by)
