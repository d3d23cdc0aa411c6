"""Incremental maintenance of a vector index: what can be reused, what must be embedded, what is out of date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import document_text
from quillmark.functions.vectors import hash_embedding


def index_records(chunks: DataFrame, packages: DataFrame) -> DataFrame:
    """source_id, chunk_id, text, content_hash, source_version: what the index holds of each chunk."""
    titles = packages.select(F.col("package_id").alias("source_id"), "title", "source_version")
    text = document_text(F.col("title"), F.col("breadcrumb"), F.col("text"))
    joined = chunks.select("source_id", "chunk_id", "breadcrumb", "text").join(titles, "source_id", "left")
    return joined.select("source_id", "chunk_id", text.alias("text"), "source_version").withColumn("content_hash", F.sha2("text", 256))


def plan_update(stored: DataFrame, current: DataFrame) -> DataFrame:
    """source_id, chunk_id, action: reuse (same version and content), embed (new or changed), drop (gone)."""
    old = stored.select("source_id", "chunk_id", F.col("content_hash").alias("old_hash"), F.col("source_version").alias("old_version"), F.lit(True).alias("was"))
    new = current.select("source_id", "chunk_id", "content_hash", "source_version", F.lit(True).alias("now"))
    both = old.join(new, ["source_id", "chunk_id"], "full")
    same = (F.col("old_hash") == F.col("content_hash")) & F.col("old_version").eqNullSafe(F.col("source_version"))
    action = F.when(F.col("now").isNull(), "drop").when(F.coalesce(same, F.lit(False)), "reuse").otherwise("embed")
    return both.select("source_id", "chunk_id", action.alias("action"))


def update_index(stored: DataFrame, current: DataFrame, embed=hash_embedding) -> DataFrame:
    """The new index: source_id, chunk_id, content_hash, source_version, vector, reused.

    ``stored`` has vectors; only records without a reusable vector are embedded, by the column function ``embed``.
    """
    old = stored.select("source_id", "chunk_id", "content_hash", "source_version", "vector")
    joined = current.join(old, ["source_id", "chunk_id", "content_hash", "source_version"], "left")
    reused = F.col("vector").isNotNull()
    return joined.select("source_id", "chunk_id", "content_hash", "source_version", F.when(reused, F.col("vector")).otherwise(embed(F.col("text"))).alias("vector"), reused.alias("reused"))


def stale_sources(stored: DataFrame, current: DataFrame) -> DataFrame:
    """source_id, indexed, expected, changed: sources whose index no longer fits; none means the index is fresh."""
    plan = plan_update(stored, current)
    per = plan.groupBy("source_id").agg(F.count_if(F.col("action") != "embed").alias("indexed"), F.count_if(F.col("action") != "drop").alias("expected"), F.count_if(F.col("action") != "reuse").alias("changed"))
    return per.where("changed > 0")


def index_status(stored: DataFrame, current: DataFrame) -> DataFrame:
    """One row: records indexed and expected, reusable ones, to embed, to drop, and whether the index is fresh."""
    n = lambda a: F.count_if(F.col("action") == a)
    totals = plan_update(stored, current).agg(n("reuse").alias("reusable"), n("embed").alias("to_embed"), n("drop").alias("to_drop"))
    return totals.select((F.col("reusable") + F.col("to_drop")).alias("indexed"), (F.col("reusable") + F.col("to_embed")).alias("expected"), "reusable", "to_embed", "to_drop", ((F.col("to_embed") == 0) & (F.col("to_drop") == 0)).alias("fresh"))


def fingerprints(records: DataFrame, keys: list[str]) -> DataFrame:
    """keys, records, fingerprint of rows (keys, json): a sha256 that tells whether a set of rows is the same, in any order.

    Rows are hashed, sorted within buckets by the first four digits of their hash, and the digests of the buckets hashed in
    order: a tree of two levels, so no source is gathered in one place. Repeated rows count.
    """
    hashed = records.select(*keys, F.sha2("json", 256).alias("hash"))
    buckets = hashed.groupBy(*keys, F.substring("hash", 1, 4).alias("bucket")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ""), 256).alias("digest"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: x.digest)  # 65,536 at most
    return buckets.groupBy(*keys).agg(F.sum("n").alias("records"), F.sha2(F.array_join(ordered, ""), 256).alias("fingerprint"))


def chunk_fingerprints(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """source_id, records, fingerprint: a digest of what is searchable of each source, whatever the order of its rows."""
    a = chunks.select("source_id", F.to_json(F.struct("asset_ids", "chunk_id", "text"), {"ignoreNullFields": "false"}).alias("json"))
    b = assets.select("source_id", F.to_json(F.struct("asset_id", "sha256", "vault_path"), {"ignoreNullFields": "false"}).alias("json"))
    return fingerprints(a.unionByName(b), ["source_id"])


def page_fingerprint(pages: DataFrame) -> DataFrame:
    """records, fingerprint: one digest of a set of pages (path, title, text)."""
    rows = pages.select(F.concat_ws("\n", "path", F.coalesce("title", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("json"))
    return fingerprints(rows.withColumn("every", F.lit(1)), ["every"]).drop("every")
