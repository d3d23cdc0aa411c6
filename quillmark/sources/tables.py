"""Readers of the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of the data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for maps that cost far more than a shuffle of their input.

    Only for plain scans: a large table already has more partitions and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def earliest(df: DataFrame, keys: list[str], keep: list[str], moment: str = "ingested_at") -> DataFrame:
    """One row per key: the columns ``keep`` of the row with the earliest ``moment``.

    A grouped minimum of a struct, so copies of a hot key are combined before the shuffle. Ties on the moment take the
    smallest kept values; a null moment sorts first only where all rows of the key have none.
    """
    late = F.when(F.col(moment).isNull(), 1).otherwise(0)
    kept = [F.col(c) for c in keep]
    ordered = [F.col(c) for c in keep if "map<" not in dict(df.dtypes)[c]]
    order = F.struct(late.alias("_late"), F.col(moment).alias("_at"), *ordered)
    if len(ordered) == len(keep):
        first = F.min(order)
    else:  # maps have no order of their own
        first = F.min_by(F.struct(F.col(moment).alias("_at"), *kept), order)
    return df.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in keep], F.col("_first._at").alias(moment))
