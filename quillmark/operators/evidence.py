"""Assets and the texts derived from them (captions, recognised text) as evidence beside chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import empty, filled


def asset_key(column: str = "sha256"):
    return F.lower(F.trim(column))


def derived_records(assets: DataFrame, cache: DataFrame) -> DataFrame:
    """source_id, asset_id, kind, text, status, model: the caption and the recognised text of each asset.

    Assets and cache records meet by content hash, without case; an asset without record has none. A record is usable
    (``searchable``) if its status is ready and its text is not blank.
    """
    slim = assets.select("source_id", "asset_id", asset_key().alias("sha256")).distinct()
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(f"{c}.text").alias("text"), F.col(f"{c}.status").alias("status"), F.col(f"{c}.model").alias("model"))
    each = cache.select("sha256", F.inline(F.array(part("image_caption", "caption"), part("image_ocr", "ocr"))))
    joined = slim.join(each, "sha256").where("status is not null")
    ready = (F.col("status") == "ready") & (F.trim(empty(F.col("text"))) != "")
    return joined.select("source_id", "asset_id", "kind", "text", "status", "model", ready.alias("searchable"))


def searchable_units(chunks: DataFrame, derived: DataFrame) -> DataFrame:
    """source_id, unit_id, modality, text: chunks and usable derived records as one set of retrieval units."""
    a = chunks.select("source_id", F.col("chunk_id").alias("unit_id"), F.coalesce(F.get("modalities", 0), F.lit("text")).alias("modality"), "text")
    b = derived.where("searchable").select("source_id", F.concat_ws("-", "asset_id", "kind").alias("unit_id"), F.col("kind").alias("modality"), "text")
    return a.unionByName(b)


def asset_parents(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_id, asset_id, items, chunks, first_page, last_page: how many items and chunks refer to each asset, and where."""
    own = lambda df, page: df.select("source_id", F.explode(F.array_distinct("asset_ids")).alias("asset_id"), page).where("asset_id is not null")
    a = own(items, F.col("page_start").alias("page")).groupBy("source_id", "asset_id").agg(F.count("*").alias("items"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    b = own(chunks, F.lit(None).cast("int").alias("page")).groupBy("source_id", "asset_id").agg(F.count("*").alias("chunks"))
    joined = a.join(b, ["source_id", "asset_id"], "full")
    return joined.select("source_id", "asset_id", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("chunks", F.lit(0)).alias("chunks"), "first_page", "last_page")


def hit_assets(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """source_id, chunk_id, asset_paths: the vault paths of a chunk's assets in their order; unknown and pathless ones are left out."""
    each = chunks.select("source_id", "chunk_id", F.posexplode("asset_ids").alias("at", "asset_id"))
    known = assets.select("source_id", "asset_id", F.nullif("vault_path", F.lit("")).alias("path")).where("path is not null")
    joined = each.join(known, ["source_id", "asset_id"])
    return joined.groupBy("source_id", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x.path).alias("asset_paths"))


def first_captions(items: DataFrame, assets: DataFrame) -> DataFrame:
    """sha256, caption: the first caption (least source, sequence, item) that any item gives an image's bytes."""
    captioned = items.where(F.trim(empty(F.col("caption"))) != "").select("source_id", "item_id", "sequence", "caption", F.explode("asset_ids").alias("asset_id"))
    joined = captioned.join(assets.select("source_id", "asset_id", asset_key().alias("sha256")), ["source_id", "asset_id"]).where("sha256 is not null")
    return joined.groupBy("sha256").agg(F.min(F.struct("source_id", "sequence", "item_id", "caption")).alias("first")).select("sha256", "first.caption")


def image_payload(items: DataFrame, assets: DataFrame) -> DataFrame:
    """source_id, path, item_id: the images that items refer to, each path once (by its first item)."""
    each = items.select("source_id", "item_id", "sequence", F.explode("asset_ids").alias("asset_id"))
    images = assets.where("media_type like 'image/%'").select("source_id", "asset_id", filled(F.col("vault_path"), F.col("path")).alias("path")).where("path <> ''")
    joined = each.join(images, ["source_id", "asset_id"])
    return joined.groupBy("source_id", "path").agg(F.min(F.struct("sequence", "item_id")).alias("first")).select("source_id", "path", "first.item_id")
