"""Positions and running sums in the order of a group, without putting a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, group: list[str], coarse: Column, order: list[Column | str], size: Column, name: str) -> DataFrame:
    """rows with ``name``: the sum of ``size`` over the rows of the group up to and with this one.

    ``coarse`` is a leading part of the order with few rows per value (a page, a range of a sequence): rows are summed
    within (group, coarse), and the sums of the earlier parts are added. Only one row per part is ordered as a whole.
    Null parts and groups are parts and groups of their own; a null size counts as 0.
    """
    keys = [*group, "_part"]
    cut = rows.withColumn("_part", coarse).withColumn("_size", F.coalesce(size, F.lit(0)))
    sums = cut.groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = cut.withColumn("_own", F.sum("_size").over(inside))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & own[k].eqNullSafe(base[f"_key{i}"])
    return own.join(base, same, "left").select(*[own[c] for c in rows.columns], (F.col("_base") + F.col("_own")).alias(name))


def positions(rows: DataFrame, group: list[str], coarse: Column, order: list[Column | str], name: str = "position") -> DataFrame:
    """rows with ``name``: the number, from 1, of each row within its group; see running_sum."""
    return running_sum(rows, group, coarse, order, F.lit(1), name).withColumn(name, F.col(name).cast("int"))


def top_rows(rows: DataFrame, group: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark keeps k rows per group before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
