"""Reciprocal rank fusion and merging of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.order import top_rows

RRF_K = 60


def fuse(lists: dict[str, DataFrame], key: str, k: int, order: list[Column | str] | None = None) -> DataFrame:
    """query_id, rank, key, score, channels of several ranked lists (query_id, rank, key).

    Each list adds 1 / (60 + rank); the sum is given times 1000, rounded to 6 places. ``channels`` names the lists in
    order. Ties go to the smaller key unless ``order`` says otherwise. A list without rows adds nothing.
    """
    tagged = [df.select("query_id", "rank", key, F.lit(i).alias("at"), F.lit(name).alias("channel")) for i, (name, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, tagged)
    score = F.round(F.sum(1.0 / (RRF_K + F.col("rank"))) * 1000, 6)
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "channel"))), lambda x: x.channel))
    total = every.groupBy("query_id", key).agg(score.alias("score"), names.alias("channels"))
    return top_rows(total, ["query_id"], [F.desc("score"), *(order or [key])], k).select("query_id", "rank", key, "score", "channels")


def best_of_variants(hits: DataFrame, key: str, k: int) -> DataFrame:
    """query_id, rank, key, score: the best score of each key over the variants of a query (query_id, key, score)."""
    best = hits.groupBy("query_id", key).agg(F.max("score").alias("score"))
    return top_rows(best, ["query_id"], [F.desc("score"), key], k).select("query_id", "rank", key, "score")
