"""Numbering rows of large groups without one task per group.

A range sort spreads the rows, so a hot group covers many partitions.  Only the
per-partition counts are combined afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglens.session import join_safe, materialise

_LOCAL_MASK = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str, groups: list[str] | None = None,
                total: str | None = None) -> DataFrame:
    """Add ``name`` = 1, 2, … by ``order``, restarting for each value of ``groups``.

    ``total`` optionally names a column holding the group size.
    """
    groups = groups or []
    placed = materialise(df.orderBy(*[F.col(g) for g in groups], *order))
    placed = placed.withColumn("_slot", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_slot", 33)).withColumn("_at", F.col("_slot").bitwiseAND(F.lit(_LOCAL_MASK)))
    spans = placed.groupBy("_part", *groups).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("_part", *groups, "_low",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                         *([F.sum("_n").over(whole).alias(total)] if total else []))
    numbered = join_safe(placed, spans, ["_part", *groups])
    return (numbered.withColumn(name, F.col("_at") - F.col("_low") + F.col("_before") + 1)
            .drop("_slot", "_part", "_at", "_low", "_before"))


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark cuts each partition to ``k`` before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k).withColumn(name, F.col(name).cast("bigint"))


def latest_per_group(df: DataFrame, groups: list[str], order: list[str], keep: list[str], earliest: bool = False) -> DataFrame:
    """One row per group by aggregate, so partial results combine before the shuffle."""
    rest = [c for c in keep if c not in groups and c not in order]
    key = F.struct(*[F.col(c) for c in [*order, *rest]])
    pick = (F.min if earliest else F.max)(key).alias("_pick")
    return df.groupBy(*groups).agg(pick).select(*groups, *[F.col(f"_pick.{c}").alias(c) for c in [*order, *rest]])
