"""Salting of hot join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(rows: DataFrame, keys: list[str], total: int, least: int = 50_000, most: int = 1000) -> DataFrame:
    """The keys holding more than ``max(least, total / most)`` of ``rows``.

    ``total`` is the number of rows (or a lower bound), so there are at most rows/total*most such keys: small enough to
    broadcast at any size of the input. Counts are combined on the map side.
    """
    return rows.groupBy(*keys).count().where(F.col("count") > max(least, total // most)).select(*keys)


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, spread_by: str, salts: int = 32) -> DataFrame:
    """Left join on ``keys`` where the left rows of hot keys are spread over ``salts`` tasks.

    The right rows of hot keys are repeated once per salt; all other rows have salt 0, so nothing else grows. ``keys`` are
    compared with ordinary equality: null keys match nothing and keep their left row. The join is a merge join of both sides,
    partitioned and sorted by the keys, however small one of them is.
    """
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    by = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    a = left.join(mark, keys, "left").withColumn("_salt", by).drop("_hot")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    b = right.join(mark, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return a.join(b.hint("merge"), [*keys, "_salt"], "left").drop("_salt")
