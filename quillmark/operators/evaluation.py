"""Retrieval and answer quality over evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import covers_concepts


def first_relevant(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """id, first_rank: the rank of the first hit in the case's source that holds one of its evidence items; null for none.

    ``hits``: query_id, rank, source_id, item_ids.
    """
    wanted = cases.select("id", "source_id", F.explode(F.array_distinct("evidence_item_ids")).alias("item_id")).where("item_id is not null")
    found = hits.select(F.col("query_id").alias("id"), "rank", "source_id", F.explode(F.array_distinct("item_ids")).alias("item_id"))
    best = wanted.join(found, ["id", "source_id", "item_id"]).groupBy("id").agg(F.min("rank").alias("first_rank"))
    return cases.select("id").join(best, "id", "left")


def retrieval_metrics(ranks: DataFrame, group: list[Column] | None = None) -> DataFrame:
    """cases, recall, mrr, top1, ndcg of first_relevant rows, rounded to 4 places, for all or per group."""
    r = F.col("first_rank")
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    measures = [F.count("*").alias("cases"), mean(r.isNotNull().cast("double")).alias("recall"), mean(1.0 / r).alias("mrr"), mean((r == 1).cast("double")).alias("top1"), mean(1.0 / F.log2(r + 1.0)).alias("ndcg")]
    return ranks.groupBy(*(group or [])).agg(*measures)


def concept_coverage(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """id, covered, keywords: whether an answer (id, answer) names every group of concepts, and the share of keywords."""
    joined = cases.select("id", "required_keyword_groups", "required_keywords").join(answers, "id", "left")
    words = F.filter("required_keywords", lambda w: w.isNotNull() & (w != ""))
    said = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(w))))
    share = F.when(F.size(words) > 0, F.round(said / F.size(words), 4))
    return joined.select("id", covers_concepts(F.col("answer"), F.col("required_keyword_groups")).alias("covered"), share.alias("keywords"))


def navigation_ranks(cases: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """id, source_rank, page_rank, named_rank, first_rank: how far up navigation leads to the case's source.

    ``pages``: query_id, rank, path, source_id; ``sources``: query_id, rank, source_id. ``page_rank`` is that of the first page
    of the source, ``named_rank`` that of the first page the case names; ``first_rank`` is the source's own rank, where it has
    one, else the page's.
    """
    own = cases.select(F.col("id").alias("query_id"), "source_id")
    by_source = sources.join(own, ["query_id", "source_id"]).groupBy("query_id").agg(F.min("rank").alias("source_rank"))
    by_page = pages.join(own, ["query_id", "source_id"]).groupBy("query_id").agg(F.min("rank").alias("page_rank"))
    named = cases.select(F.col("id").alias("query_id"), F.explode(F.array_distinct("wiki_page_paths")).alias("path"))
    by_name = pages.join(named, ["query_id", "path"]).groupBy("query_id").agg(F.min("rank").alias("named_rank"))
    joined = own.select("query_id").join(by_source, "query_id", "left").join(by_page, "query_id", "left").join(by_name, "query_id", "left")
    return joined.select(F.col("query_id").alias("id"), "source_rank", "page_rank", "named_rank", F.coalesce("source_rank", "page_rank").alias("first_rank"))


def baseline_summary(answers: DataFrame) -> DataFrame:
    """One row on answers (expected, found, exact, contained): counts, mean lengths, median length ratio, how many cite."""
    found, expected = F.coalesce("found", F.lit("")), F.coalesce("expected", F.lit(""))
    ratio = F.length(found) / F.greatest(F.length(expected), F.lit(1))
    return answers.agg(
        F.count("*").alias("cases"), F.count_if("exact").alias("exact"), F.count_if("contained").alias("contained"),
        F.count_if(found.rlike(r"(?i)evidence\s*id")).alias("with_evidence_id"), F.count_if(found.rlike(r"(?:〔|\[|【)\s*\d+\s*(?:〕|\]|】)")).alias("with_marker"),
        F.round(F.avg(F.length(expected)), 1).alias("mean_expected"), F.round(F.avg(F.length(found)), 1).alias("mean_found"), F.round(F.median(ratio), 2).alias("median_ratio"), F.count_if(ratio > 3).alias("over_3x"),
    )


def answer_metrics(rows: DataFrame, group: Column) -> DataFrame:
    """Per group of rows (answerable, covered, keywords, cited): cases, and the means; coverage over answerable rows only."""
    share = lambda c, when=None: F.round(F.avg(F.when(F.lit(True) if when is None else when, c.cast("double"))), 4)
    answerable = F.coalesce("answerable", F.lit(False))
    return rows.groupBy(group).agg(F.count("*").alias("cases"), share(answerable).alias("answerable"), share(F.col("covered"), answerable).alias("coverage"), share(F.col("keywords")).alias("keywords"), share(F.col("cited")).alias("citations"))
