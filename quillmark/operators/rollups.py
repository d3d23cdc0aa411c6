"""Summaries per source, section, status and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import empty
from quillmark.operators.order import top_rows


def source_summary(packages: DataFrame, items: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per package: items, kinds of items, rich items, chunks, pages. Packages without any have zeros."""
    rich = F.col("item_type").isin("image", "figure", "chart", "table", "equation") | (F.size("asset_ids") > 0)
    a = items.groupBy("source_id").agg(F.count("*").alias("items"), F.array_join(F.sort_array(F.collect_set("item_type")), ",").alias("kinds"), F.count_if(rich).alias("rich_items"))
    b = chunks.groupBy("source_id").agg(F.count("*").alias("chunks"))
    c = pages.groupBy(F.col("package_id").alias("source_id")).agg(F.count("*").alias("pages"))
    base = packages.select(F.col("package_id").alias("source_id"), "title")
    joined = base.join(a, "source_id", "left").join(b, "source_id", "left").join(c, "source_id", "left")
    zero = [F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("items", "rich_items", "chunks", "pages")]
    return joined.select("source_id", "title", empty(F.col("kinds")).alias("kinds"), *zero)


def outline(items: DataFrame) -> DataFrame:
    """Sections of each source: first place, items, kinds, first and last page, number of pages."""
    section = F.coalesce(F.nullif("breadcrumb", F.lit("")), F.lit("未分节"))
    return items.groupBy("source_id", section.alias("section")).agg(
        F.min("sequence").alias("first_sequence"),
        F.count("*").alias("items"),
        F.array_join(F.sort_array(F.collect_set("item_type")), ", ").alias("kinds"),
        F.min("page_start").alias("first_page"),
        F.max("page_start").alias("last_page"),
        F.countDistinct("page_start").alias("pages"),
    )


def usage(events: DataFrame, kind: str, json: str) -> DataFrame:
    """kind, key, total, records: sums of the numeric leaves of a JSON column per kind and key. Other leaves are skipped."""
    leaves = events.select(kind, F.explode(F.from_json(json, "map<string,string>")).alias("key", "text"))
    number = F.expr("try_cast(text as double)")
    return leaves.withColumn("number", F.floor(number)).where("number is not null").groupBy(kind, "key").agg(F.sum("number").cast("bigint").alias("total"), F.count("*").alias("records"))


def histogram(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """field, value, records: how often each value of each column occurs; null and empty count as ``unknown``."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for n, c in columns.items()])
    return rows.select(F.inline(each)).groupBy("field", "value").agg(F.count("*").alias("records"))


def nearest_rank(rows: DataFrame, group: list[str], value: str, ratio: float = 0.95) -> DataFrame:
    """Per group: records, mean and nearest-rank percentile of a value (nulls left out)."""
    return rows.groupBy(*group).agg(F.count(value).alias("records"), F.round(F.avg(value), 3).alias("mean"), F.round(F.expr(f"percentile_disc({ratio}) within group (order by {value})"), 3).alias("p95"))


def candidate_sources(hits: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, source_id, best, hits: sources of a query's hits by best score, then number of hits."""
    each = hits.groupBy("query_id", "source_id").agg(F.max("score").alias("best"), F.count("*").alias("hits"))
    return top_rows(each, ["query_id"], [F.desc("best"), F.desc("hits"), "source_id"], k)
