"""Rendering, upserting and curating wiki pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import collapse, empty, evidence_id, item_text, table_markdown
from quillmark.operators.context import stretch
from quillmark.operators.skew import hot_keys, salted_left_join


def rendered_item(version: Column) -> Column:
    """One item as Markdown: its text, table and formula, and the id to cite it by; empty parts are left out."""
    text = F.trim(item_text(F.col("raw_text"), F.col("caption"), F.col("search_text")))
    formula = F.when(empty(F.col("latex")) != "", F.concat(F.lit("$$"), F.col("latex"), F.lit("$$"))).otherwise("")
    parts = F.array(text, table_markdown(F.col("table_rows")), formula, F.concat(F.lit("`"), evidence_id(F.col("source_id"), version, F.col("item_id")), F.lit("`")))
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), "\n\n")


def rendered_pages(items: DataFrame) -> DataFrame:
    """source_id, page, part, items, markdown: items in order, one row per page of a source.

    A very long page (and the items without page) comes in parts of a range of the sequence, so no group is unbounded.
    """
    block = rendered_item(empty(F.col("source_version")))
    each = items.select("source_id", F.col("page_start").alias("page"), stretch(F.col("sequence")).cast("int").alias("part"), F.struct(F.coalesce("sequence", F.lit(0)).alias("sequence"), F.col("item_id"), block.alias("block")).alias("row"))
    grouped = each.groupBy("source_id", "page", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("source_id", "page", "part", F.size("rows").alias("items"), F.array_join(F.transform("rows", lambda r: r.block), "\n\n").alias("markdown"))


def upsert_pages(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """path, title, source_ids, revision, changed: pages after an update.

    Both: path, title, source_ids, content_hash; ``previous`` also revision. An incoming page takes its place in the union
    of sources (old ones first) and raises the revision if its content changed; other pages stay.
    """
    old = previous.select("path", F.col("title").alias("old_title"), F.col("source_ids").alias("old_sources"), F.col("content_hash").alias("old_hash"), "revision")
    both = old.join(incoming.select("path", "title", "source_ids", "content_hash"), "path", "full")
    none = F.array().cast("array<string>")
    changed = F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(F.col("old_hash"))
    return both.select(
        "path",
        F.coalesce("title", "old_title").alias("title"),
        F.array_distinct(F.concat(F.coalesce("old_sources", none), F.coalesce("source_ids", none))).alias("source_ids"),
        (F.coalesce("revision", F.lit(0)) + changed.cast("int")).alias("revision"),
        changed.alias("changed"),
    )


def curated_pages(pages: DataFrame, keep: DataFrame) -> DataFrame:
    """path, action: what becomes of pages (path, source_ids) if only the sources ``keep`` (source_id) stay.

    keep: all its sources stay; drop: none does; mixed: some do, so a person must decide. Pages without sources stay.
    """
    each = pages.select("path", F.explode("source_ids").alias("source_id")).join(keep.select("source_id").distinct().withColumn("kept", F.lit(1)), "source_id", "left")
    judged = each.groupBy("path").agg(F.count("*").alias("n"), F.count("kept").alias("k"))
    action = F.when(F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0)), "keep").when(F.col("k") == 0, "drop").otherwise("mixed")
    return pages.select("path").distinct().join(judged, "path", "left").select("path", action.alias("action"))


def curated_by_title(pages: DataFrame, members: DataFrame, keep: DataFrame, total: int = 0) -> DataFrame:
    """path, action as curated_pages, for pages that have all sources of their title.

    ``pages``: path, title, package_id; ``members``: title, package_id of all pages. What a title's sources come to is
    counted once per title and joined, so pages that share a title never meet all its sources. A page without a title has
    its own source only.
    """
    kept = keep.select(F.col("source_id").alias("package_id")).distinct().withColumn("kept", F.lit(1))
    each = members.where("package_id is not null").select("title", "package_id").distinct().join(kept, "package_id", "left")
    titles = each.where("title is not null").groupBy("title").agg(F.count("*").alias("n"), F.count("kept").alias("k"))
    alone = pages.where("title is null").join(kept, "package_id", "left").select("path", F.col("package_id").isNotNull().cast("int").alias("n"), F.coalesce("kept", F.lit(0)).alias("k"))
    titled = pages.where("title is not null").select("path", "title")
    joined = salted_left_join(titled, titles, ["title"], hot_keys(titled, ["title"], total), "path").select("path", "n", "k")
    action = F.when(F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0)), "keep").when(F.col("k") == 0, "drop").otherwise("mixed")
    return joined.unionByName(alone).select("path", action.alias("action")).distinct()


def stale_pages(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """path, source_id, current: pages (path, source_ids, source_versions) that do not know a source's current version.

    A source without a current version makes no page stale.
    """
    each = pages.select("path", "source_versions", F.explode("source_ids").alias("source_id"))
    joined = each.join(versions.select("source_id", F.col("source_version").alias("current")), "source_id")
    return joined.where(F.col("current").isNotNull() & ~F.coalesce(F.array_contains("source_versions", F.col("current")), F.lit(False))).select("path", "source_id", "current")


def page_summary(text: Column) -> Column:
    """A page's first line that is not blank, without heading marks."""
    lines = F.filter(F.transform(F.split(empty(text), "\n"), lambda x: collapse(F.regexp_replace(x, r"^#+", ""))), lambda x: x != "")
    return F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
