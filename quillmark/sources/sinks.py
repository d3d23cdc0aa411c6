"""Writing tables: appended logs, replaced partitions, and tables that are written only when they change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: their number and the sum of their 64-bit hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s or 0}"


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a log."""
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Write df over ``path`` unless that holds the same rows; whether it was written."""
    if read_or_empty(df.sparkSession, path, df.schema.simpleString()) is not None and digest(df.sparkSession.read.parquet(path)) == digest(df):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``; None where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop) else None
