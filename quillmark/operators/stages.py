"""Builds in stages: signatures, what must be built again, and indexes of pages and visuals that reuse vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import document_text, empty
from quillmark.functions.vectors import hash_embedding
from quillmark.operators.evidence import asset_key


def signature(*parts: Column) -> Column:
    """The first 16 digits of the sha256 of a build's contract; null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[empty(p.cast("string")) for p in parts]), 256), 1, 16)


def stage_plan(stored: DataFrame, current: DataFrame) -> DataFrame:
    """source_id, text_action, visual_action: what a build has to do for each source.

    ``stored``: source_id, source_version, text_signature, visual_signature (null: not built); ``current``: source_id,
    source_version, text_signature, visual_signature. Text is kept if version and signature are the same, else built. The
    visual stage needs text of the same version: it waits for text that is built anew (its own state is dropped), is kept
    if its signature is the same, else built. A source that is gone is dropped.
    """
    old = stored.select("source_id", F.col("source_version").alias("old_version"), F.col("text_signature").alias("old_text"), F.col("visual_signature").alias("old_visual"), F.lit(True).alias("was"))
    both = current.withColumn("now", F.lit(True)).join(old, "source_id", "full")
    same = F.col("source_version").eqNullSafe(F.col("old_version")) & F.coalesce(F.col("text_signature") == F.col("old_text"), F.lit(False))
    gone = F.col("now").isNull()
    text = F.when(gone, "drop").when(same, "keep").otherwise("build")
    visual = F.when(gone, "drop").when(~same, F.when(F.col("old_visual").isNotNull(), "drop").otherwise("wait")).when(F.coalesce(F.col("visual_signature") == F.col("old_visual"), F.lit(False)), "keep").otherwise("build")
    return both.select("source_id", text.alias("text_action"), visual.alias("visual_action"))


def changed_sources(stored: DataFrame, current: DataFrame, selected: DataFrame) -> DataFrame:
    """source_id, stored_version, current_version: sources outside ``selected`` whose version changed; a build that keeps
    them must stop unless there are none."""
    a = stored.select("source_id", F.col("source_version").alias("stored_version"))
    b = current.select("source_id", F.col("source_version").alias("current_version"))
    return a.join(b, "source_id").join(selected, "source_id", "left_anti").where(~F.col("stored_version").eqNullSafe(F.col("current_version")))


def page_records(pages: DataFrame) -> DataFrame:
    """path, text, content_hash of pages (path, title, text)."""
    return pages.select("path", document_text(F.col("title"), F.col("text")).alias("text")).withColumn("content_hash", F.sha2("text", 256))


def update_page_index(stored: DataFrame, current: DataFrame, embed=hash_embedding) -> DataFrame:
    """path, content_hash, vector, reused: vectors of pages, embedded only where path or content is new."""
    old = stored.select("path", "content_hash", "vector")
    joined = current.join(old, ["path", "content_hash"], "left")
    known = F.col("vector").isNotNull()
    return joined.select("path", "content_hash", F.when(known, F.col("vector")).otherwise(embed(F.col("text"))).alias("vector"), known.alias("reused"))


def visual_records(assets: DataFrame, derived: DataFrame, packages: DataFrame) -> DataFrame:
    """source_id, asset_id, path, sha256, source_version: the assets with a usable caption or text, which alone are indexed."""
    ready = derived.where("searchable").select("source_id", "asset_id").distinct()
    versions = packages.select(F.col("package_id").alias("source_id"), "source_version")
    own = assets.where("sha256 is not null").select("source_id", "asset_id", F.coalesce("vault_path", "path").alias("path"), asset_key().alias("sha256"))
    return own.join(ready, ["source_id", "asset_id"], "left_semi").join(versions, "source_id", "left")


def update_visual_index(stored: DataFrame, current: DataFrame, embed=hash_embedding) -> DataFrame:
    """source_id, asset_id, path, sha256, vector, reused: vectors of visuals, reused where key, bytes and version are the same.

    Equal bytes are embedded once, whatever packages hold them.
    """
    keys = ["source_id", "asset_id", "path", "sha256", "source_version"]
    old = stored.select(*keys, "vector")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"o.{k}"))
    joined = current.alias("c").join(old.alias("o"), (F.col("c.asset_id") == F.col("o.asset_id")) & same, "left").select("c.*", "o.vector")
    fresh = joined.where("vector is null").select("sha256").distinct().withColumn("fresh", embed(F.col("sha256")))
    return joined.join(fresh, "sha256", "left").select("source_id", "asset_id", "path", "sha256", F.coalesce("vector", "fresh").alias("vector"), F.col("vector").isNotNull().alias("reused"))
