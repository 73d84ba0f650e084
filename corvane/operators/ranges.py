"""Ranges of an order, so that running figures over one long sequence are many tasks' work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranged(rows: DataFrame, order: str, parts: int = 256) -> DataFrame:
    """rows with _r, the range of their order: ranges of about as many rows each, whatever the values (equal values share a range)."""
    share = [k / parts for k in range(1, parts)]
    cuts = rows.agg(F.percentile_approx(order, share, 10 * parts).alias("_cuts"))  # one row of at most `parts` numbers
    return rows.join(F.broadcast(cuts)).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running_total(rows: DataFrame, groups: list[str], order: str, size: Column, name: str, parts: int = 256, ties: list[str] | None = None) -> DataFrame:
    """rows with `name`: the sum of size over the rows of their group before them. Sums by range first, then rows within a range."""
    rows = ranged(rows.withColumn("_s", size), order, parts)
    within = Window.partitionBy(*groups, "_r").orderBy(order, *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_s").over(within), F.lit(0)))
    sums = rows.groupBy(*groups, "_r").agg(F.sum("_s").alias("_n"))
    ranges = Window.partitionBy(*groups).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*groups, "_r", F.coalesce(F.sum("_n").over(ranges), F.lit(0)).alias("_before"))
    return rows.join(before, [*groups, "_r"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_r", "_s", "_in", "_before")
