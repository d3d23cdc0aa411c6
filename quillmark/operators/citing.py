"""From evidence to citations: the hits, pages, titles and places behind each piece of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import empty, filled

# fixed values: the order in which kinds of pages lend their title to evidence
KIND_ORDER = ("entity", "analysis", "concept")


def page_evidence(cases: DataFrame) -> DataFrame:
    """path, source_id, item_id: what each page rests on, as the cases that name both tell; blank values are left out."""
    pages = cases.select("source_id", "evidence_item_ids", F.explode(F.array_distinct("wiki_page_paths")).alias("path"))
    each = pages.select("path", "source_id", F.explode(F.array_distinct("evidence_item_ids")).alias("item_id"))
    return each.where("path <> '' and item_id <> '' and source_id is not null").distinct()


def supporting_pages(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """source_id, item_id, path, title, kind: the pages (path, title, kind) that rest on each piece of evidence and exist."""
    return evidence.join(pages.select("path", "title", "kind"), "path").select("source_id", "item_id", "path", "title", "kind")


def evidence_titles(evidence: DataFrame, supporting: DataFrame, packages: DataFrame) -> DataFrame:
    """source_id, item_id, title, path: the title to name evidence by.

    That of the supporting page first in KIND_ORDER, then by title and path; else that of the source (path null).
    """
    place = F.lit(len(KIND_ORDER))
    for n, kind in reversed(list(enumerate(KIND_ORDER))):
        place = F.when(F.col("kind") == kind, n).otherwise(place)
    titled = supporting.where("title <> ''")
    best = titled.groupBy("source_id", "item_id").agg(F.min(F.struct(place.alias("place"), "title", "path")).alias("best")).select("source_id", "item_id", "best.title", "best.path")
    sources = packages.select(F.col("package_id").alias("source_id"), F.col("title").alias("source_title"))
    joined = evidence.select("source_id", "item_id").distinct().join(best, ["source_id", "item_id"], "left").join(sources, "source_id", "left")
    return joined.select("source_id", "item_id", filled(F.col("title"), F.col("source_title"), F.col("source_id")).alias("title"), "path")


def cited_hits(selected: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, place, source_id, item_id, hit_rank, hit_key, score, channel: the hit behind each selected piece of evidence.

    ``selected``: query_id, place, source_id, item_id; ``hits``: query_id, rank, doc_key, score, source_id, item_ids. The first
    hit of the same source that holds the item counts; evidence that no hit holds gets a hit of its own with score 0.
    """
    each = hits.select("query_id", "source_id", F.explode(F.array_distinct("item_ids")).alias("item_id"), F.struct("rank", "doc_key", "score").alias("hit"))
    first = each.groupBy("query_id", "source_id", "item_id").agg(F.min("hit").alias("hit"))
    joined = selected.join(first, ["query_id", "source_id", "item_id"], "left")
    there = F.col("hit").isNotNull()
    own = F.concat(F.lit("adjacent-context-"), F.col("item_id"))
    return joined.select("query_id", "place", "source_id", "item_id", F.col("hit.rank").alias("hit_rank"), F.coalesce("hit.doc_key", own).alias("hit_key"), F.coalesce("hit.score", F.lit(0.0)).alias("score"), F.when(there, "bm25").otherwise("adjacent_context").alias("channel"))


def citation_order(answers: DataFrame) -> DataFrame:
    """query_id, place, doc_key: the ids (array ``citations``) in the order an answer first cites them, those it doesn't last."""
    each = answers.select("query_id", "answer", F.posexplode("citations").alias("given", "doc_key"))
    spot = F.instr(F.col("answer"), F.concat(F.lit("["), F.col("doc_key"), F.lit("]")))
    listed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((spot == 0).alias("uncited"), spot.alias("spot"), "given", "doc_key"))).alias("c"))  # the ids of one answer
    return listed.select("query_id", F.posexplode("c").alias("n", "x")).select("query_id", (F.col("n") + 1).alias("place"), "x.doc_key")


def evidence_label(item_type: Column, caption: Column, breadcrumb: Column, longest: int = 60) -> Column:
    """A short name for evidence: the caption's head before a colon, else the last part of its section, else its type."""
    head = F.trim(F.regexp_extract(empty(caption), "^([^:：]*)[:：]", 1))
    section = F.trim(F.substring_index(empty(breadcrumb), " > ", -1))
    name = filled(F.when(F.length(head).between(1, longest), head), section, item_type)
    return F.when(F.length(name) > longest, F.concat(F.substring(name, 1, longest - 3), F.lit("…"))).otherwise(name)


def hit_pages(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """query_id, rank, doc_key, source_id, pages, first_page: hits with how many pages their source has, and the first."""
    per = pages.where("package_id is not null").groupBy(F.col("package_id").alias("source_id")).agg(F.count("*").alias("pages"), F.min("path").alias("first_page"))
    return hits.join(per, "source_id", "left").select("query_id", "rank", "doc_key", "source_id", F.coalesce("pages", F.lit(0)).alias("pages"), "first_page")


def first_with_asset(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """query_id, rank, doc_key, with_asset: the first hit that shows an asset (source_id, chunk_id), else the first hit."""
    shown = assets.select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), F.lit(True).alias("with_asset"))
    joined = hits.select("query_id", "rank", "doc_key").join(shown, "doc_key", "left")
    best = joined.groupBy("query_id").agg(F.min(F.struct(F.col("with_asset").isNull().alias("without"), "rank", "doc_key")).alias("b"))
    return best.select("query_id", "b.rank", "b.doc_key", (~F.col("b.without")).alias("with_asset"))


def merged_actions(actions: DataFrame) -> DataFrame:
    """title, kind, action, reasons of page actions (n, title, kind, action, reason), one per title (without case) and kind.

    The first title in the order of ``n`` stands; one update makes the action an update; distinct reasons in the order in
    which they first appear.
    """
    key = F.lower(F.trim("title"))
    known = actions.where("title is not null").withColumn("key", key)
    reasons = known.where("reason <> ''").groupBy("key", "kind", "reason").agg(F.min("n").alias("n"))
    listed = reasons.groupBy("key", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "reason"))), lambda x: x.reason), "；").alias("reasons"))  # distinct reasons only
    heads = known.groupBy("key", "kind").agg(F.min(F.struct("n", "title")).alias("head"), F.max("action").alias("action"))
    same = heads.join(listed.withColumnRenamed("key", "k").withColumnRenamed("kind", "d"), (F.col("key") == F.col("k")) & F.col("kind").eqNullSafe(F.col("d")), "left")
    return same.select("head.title", "kind", "action", F.coalesce("reasons", F.lit("")).alias("reasons"))


def matching_pages(pages: DataFrame, actions: DataFrame) -> DataFrame:
    """The pages (path, title, kind) that an action (title, kind) names, titles compared without case and outer blanks."""
    wanted = actions.select(F.lower(F.trim("title")).alias("key"), "kind").distinct()
    return pages.withColumn("key", F.lower(F.trim("title"))).join(wanted, ["key", "kind"], "left_semi").select("path", "title", "kind")
