"""Places for models: any Python callable of the right shape runs as an Arrow-batched function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedder(model: Callable[[list[str]], list[list[float]]], batch: int = 5):
    """A column function that embeds texts in small batches, in order; null texts give null."""

    @F.pandas_udf("array<double>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            known = [t for t in texts if t is not None]
            vectors = [v for i in range(0, len(known), batch) for v in model(known[i : i + batch])]
            found = iter(vectors)
            yield pd.Series([next(found) if t is not None else None for t in texts])

    return embed


def rerank(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], k: int) -> DataFrame:
    """query_id, rank, doc_key, score: candidates (query_id, query, doc_key, text) scored anew as pairs, the best k kept.

    Pairs are scored where they lie, in batches; only scores are shuffled. Ties go to the smaller doc_key.
    """
    from quillmark.operators.order import top_rows

    types = dict(candidates.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["query_id", "doc_key"]].assign(score=[float(s) for s in scorer(pdf["query"].tolist(), pdf["text"].tolist())])

    scored = candidates.select("query_id", "query", "doc_key", "text").mapInPandas(run, f"query_id {types['query_id']}, doc_key {types['doc_key']}, score double")
    return top_rows(scored, ["query_id"], [F.desc("score"), "doc_key"], k)


def fill_cache(wanted: DataFrame, cache: DataFrame, key: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """key, text, status: ``wanted`` (key, input) from the cache (key, text, status = ready), models called for misses only.

    Equal keys are called once; a failed call gives status error for its batch and is not cached as ready.
    """
    ready = cache.where("status = 'ready'").select(key, "text")
    missing = wanted.groupBy(key).agg(F.min("input").alias("input")).join(ready, key, "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield pdf[[key]].assign(text=model(pdf["input"].tolist()), status="ready")
            except Exception as problem:  # noqa: BLE001 - whatever the model raises stays with its batch
                yield pdf[[key]].assign(text=str(problem), status="error")

    called = missing.mapInPandas(run, f"{key} string, text string, status string")
    hit = wanted.select(key).distinct().join(ready, key).withColumn("status", F.lit("ready"))
    return hit.unionByName(called)
