"""Cosine search of a stated set of query vectors against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.order import top_rows

BLOCK = 4096


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, skip_self: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: exact cosine top k, scores rounded to 6 places, ties to the smaller vec_id.

    ``queries``: query_id, vector; ``vectors``: vec_id, vector. Null, empty and zero vectors and other dimensions than the
    query's score 0 and are left out. Queries go out in blocks of BLOCK; each task multiplies its vectors with a block and
    passes on its best k.
    """
    rows = sorted(queries.where("vector is not null").select("query_id", "vector").collect(), key=lambda r: r.query_id)
    spark, parts = vectors.sparkSession, []
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    for dimension in sorted({len(r.vector) for r in rows if len(r.vector)}):
        own = [r for r in rows if len(r.vector) == dimension]
        for start in range(0, len(own), BLOCK):
            block = own[start : start + BLOCK]
            matrix = np.array([r.vector for r in block], float)
            norm = np.linalg.norm(matrix, axis=1)
            block, matrix = [r for r, x in zip(block, norm, strict=True) if x > 0], (matrix[norm > 0] / norm[norm > 0, None])
            shared = spark.sparkContext.broadcast(([r.query_id for r in block], matrix))

            def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                names, matrix = shared.value
                for pdf in batches:
                    pdf = pdf.sort_values("vec_id", ignore_index=True)
                    data = np.stack(pdf["vector"].to_list()).astype(float) if len(pdf) else np.zeros((0, matrix.shape[1]))
                    size = np.linalg.norm(data, axis=1)
                    score = (matrix @ (data / np.where(size > 0, size, 1.0)[:, None]).T).round(6)
                    score[:, size == 0] = -2
                    if skip_self:
                        score[pd.Index(names).to_numpy()[:, None] == pdf["vec_id"].to_numpy()[None, :]] = -2
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    values = np.take_along_axis(score, best, axis=1)
                    good = values > -2
                    q = np.repeat(np.arange(len(names)), best.shape[1]).reshape(best.shape)
                    if good.any():
                        yield pd.DataFrame({"query_id": [names[x] for x in q[good]], "vec_id": pdf["vec_id"].to_numpy()[best[good]], "score": values[good]})

            usable = vectors.where(F.size("vector") == dimension).where(~F.exists("vector", lambda x: x.isNull()))
            parts.append(usable.select("vec_id", "vector").mapInPandas(run, schema))
    found = spark.createDataFrame([], schema)
    for p in parts:
        found = found.unionByName(p)
    return top_rows(found, ["query_id"], [F.desc("score"), "vec_id"], k).select("query_id", "rank", "vec_id", "score")


def mean_of_best(scores: DataFrame, best: int = 3, k: int = 8) -> DataFrame:
    """query_id, rank, source_id, score: sources by the mean of their best scores (query_id, source_id, score, vec_id)."""
    own = top_rows(scores, ["query_id", "source_id"], [F.desc("score"), "vec_id"], best)
    mean = own.groupBy("query_id", "source_id").agg(F.round(F.avg("score"), 6).alias("score"))
    return top_rows(mean, ["query_id"], [F.desc("score"), "source_id"], k).select("query_id", "rank", "source_id", "score")
