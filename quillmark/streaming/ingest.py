"""Incremental ingestion as a file stream: new files are merged by key, each file once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import shared_folder
from quillmark.sources.tables import earliest


def file_stream(spark: SparkSession, source: str, files_per_batch: int) -> DataFrame:
    """A stream of the Parquet files of a folder, or of a single file (then the folder above is watched for its name)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    reader = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", files_per_batch)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(source)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def stream_upsert(spark: SparkSession, source: str, keys: list[str], keep: list[str], moment: str = "ingested_at", files_per_batch: int = 4) -> DataFrame:
    """The current row (earliest ``moment``) of each key, after streaming all files under ``source``.

    Each micro-batch reduces its rows to one per key and writes them to a folder named by its number, so a batch that runs
    twice replaces itself; readers reduce the folders by key. State and checkpoint lie in the shared folder. Late rows need
    no watermark: the order of arrival does not matter to a minimum.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(source).schema
    stream = file_stream(spark, source, files_per_batch)

    def merge(batch: DataFrame, number: int) -> None:
        earliest(batch, keys, keep, moment).write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    written = spark.read.schema(",".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name in {*keys, *keep, moment})).parquet(f"{base}/rows")
    return earliest(written, keys, keep, moment)


def stream_counts(spark: SparkSession, source: str, moment: str, group: str, window: str = "1 day") -> DataFrame:
    """start, group, n: counts of all rows per window and group, after streaming all files under ``source``.

    Each micro-batch writes its partial counts to a folder named by its number, so a batch that runs twice replaces itself;
    readers add the folders up. A sum does not depend on the order of arrival, so late rows need no watermark and count as
    any other. Rows with a null ``moment`` lie in no window.
    """
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = file_stream(spark, source, 4).withColumn(moment, F.col(moment).cast("timestamp"))

    def count(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window(moment, window).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")

    def add(batch: DataFrame, number: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(count(stream).schema).parquet(f"{base}/counts").groupBy("start", group).agg(F.sum("n").alias("n"))
