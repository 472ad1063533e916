"""Positions and running sums in a global order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.workspace import hold

#: Rows up to which one task sorts them all.
SMALL = 1 << 18


def numbered(df: DataFrame, order: list[Column], within: list[str] = (), name: str = "position") -> DataFrame:
    """``df`` with the gapless position from 0 of each row, in ``order``, among the rows equal in ``within``.

    Rows are range-partitioned by ``order``; a row's position is its rank in its range plus the counts of the ranges before.
    Only the counts, one row per range and group, meet in one place.
    """
    ranged = hold(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *within).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_within_{i}" for i in range(len(within))]
    offsets = counts.select(F.col("_range").alias("_of"), *(F.col(c).alias(n) for c, n in zip(within, names, strict=True)), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = ranged.withColumn("_rank", F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order)) - 1)
    condition = F.col("_range") == F.col("_of")
    for c, n in zip(within, names, strict=True):
        condition &= F.col(c).eqNullSafe(F.col(n))
    return ranked.join(offsets, condition).select(*df.columns, (F.col("_rank") + F.col("_offset")).cast("long").alias(name))


def running_sums(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df``, with one row per ``key``, plus ``cum_`` sums of ``columns`` up to each key and the ``next_`` key."""
    table = hold(df)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    if table.count() <= SMALL:
        whole = Window.orderBy(key)
        return table.select("*", *(F.sum(c).over(whole.rowsBetween(*up_to)).alias(f"cum_{c}") for c in columns), F.lead(key).over(whole).alias(f"next_{key}"))
    ranged = hold(table.repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    ranges = ranged.groupBy("_range").agg(F.min(key).alias("_low"), *(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.orderBy("_range")
    ranges = ranges.select(
        "_range", F.lead("_low").over(before).alias("_after"), *(F.coalesce(F.sum(f"_{c}").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{c}") for c in columns)
    )
    inside = Window.partitionBy("_range").orderBy(key)
    local = ranged.select("*", *(F.sum(c).over(inside.rowsBetween(*up_to)).alias(f"_in_{c}") for c in columns), F.lead(key).over(inside).alias("_lead"))
    return local.join(ranges, "_range").select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_{c}")).alias(f"cum_{c}") for c in columns), F.coalesce("_lead", "_after").alias(f"next_{key}"))
