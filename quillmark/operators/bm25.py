"""BM25 ranking of chunks and pages for a stated set of queries.

The tokens of the documents are read once: a map keeps, of each document, its length and the counts of the terms that any
query asks for. Statistics (number of documents, mean length, document frequencies) are Spark aggregates over that table.
Scoring is a second map over it: each posting meets the queries that hold its term and no others, and every task passes on
its best k rows of each query, so what is shuffled grows with the number of tasks, not with the documents in them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.order import top_rows
from quillmark.session import cut_lineage

K1, B, LABEL_BOOST, INTENT_BOOST, AUTHORITY = 1.2, 0.75, 6.0, 4.0, 0.15
BLOCK, BATCH = 1000, 512


def postings(documents: DataFrame, terms: list[str]) -> DataFrame:
    """The documents with ``size`` (tokens), ``terms`` and ``counts`` (numbers and counts of the known terms) for tokens.

    ``source_id`` is kept where there is one.
    """
    shared = documents.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    keep = [c for c in ("doc_key", "labels", "visual", "tabular", "extra", "source_id") if c in documents.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shared.value
        width = max(1, len(number))
        for pdf in batches:
            lists = [[number[t] for t in own if t in number] for own in pdf["tokens"]]
            doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            pair, counts = np.unique(doc * width + np.array([t for x in lists for t in x], np.int64), return_counts=True)
            edges = np.searchsorted(pair, np.arange(1, len(lists)) * width)
            yield pdf[keep].assign(size=pdf["tokens"].map(len), terms=np.split((pair % width).astype(np.int32), edges), counts=np.split(counts.astype(np.int32), edges))

    types = dict(documents.dtypes)
    return documents.select(*keep, "tokens").mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", size int, terms array<int>, counts array<int>")


def rank_documents(queries: DataFrame, documents: DataFrame, k: int = 10, nudges: DataFrame | None = None) -> DataFrame:
    """query_id, rank, doc_key, score: the best k documents of each query.

    ``queries``: query_id, tokens, labels, visual, tabular; ``documents``: doc_key, tokens, labels, visual, tabular, extra
    (added to scores that are above 0). Score = BM25 + 6 for a shared label + 4 where both are visual + 4 where both are
    tabular; ties go to the smaller doc_key. Scores are rounded to 6 places before ranking. Documents without tokens and
    queries without tokens match by labels and intent only. ``nudges``: query_id, source_id, nudge, a few per query, are
    added for all documents of a source, also to a score of 0. The queries are a stated set: they go to the tasks in blocks of
    BLOCK, each of which reads the postings once.
    """
    rows = sorted(queries.select("query_id", F.array_distinct("tokens").alias("tokens"), "labels", "visual", "tabular").collect(), key=lambda r: str(r.query_id))
    types = dict(queries.dtypes)["query_id"], dict(documents.dtypes)["doc_key"]
    found = documents.sparkSession.createDataFrame([], f"query_id {types[0]}, doc_key {types[1]}, score double")
    terms = sorted({t for r in rows for t in r.tokens})
    known = cut_lineage(postings(documents, terms))
    total = known.agg(F.count("*").alias("n"), F.avg("size").alias("mean")).first()
    df = np.zeros(len(terms))
    for r in known.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    idf = np.log(1 + (total.n - df + 0.5) / (df + 0.5))
    number = {t: i for i, t in enumerate(terms)}
    pushed: dict[str, dict[str, float]] = {}
    for r in nudges.select("query_id", "source_id", "nudge").collect() if nudges is not None else ():
        pushed.setdefault(r.query_id, {})[r.source_id] = r.nudge
    for start in range(0, len(rows), BLOCK):
        part = score_block(rows[start : start + BLOCK], known, number, idf, max(total["mean"] or 0.0, 1.0), k, types, pushed)
        found = part if start == 0 else found.unionByName(part)
    return top_rows(found, ["query_id"], [F.desc("score"), "doc_key"], k).select("query_id", "rank", "doc_key", "score")


def score_block(rows: list, known: DataFrame, number: dict[str, int], idf: np.ndarray, mean: float, k: int, types: tuple[str, str], pushed: dict[str, dict[str, float]]) -> DataFrame:
    """query_id, doc_key, score: of the documents of each task the best k for each query of a block."""
    # the queries of each term: those of term t are asked[first[t]:first[t + 1]]
    holds = sorted((number[t], j) for j, r in enumerate(rows) for t in r.tokens)
    asked = np.array([j for _, j in holds], np.int64)
    first = np.searchsorted(np.array([t for t, _ in holds], np.int64), np.arange(len(number) + 1))
    marks = sorted({x for r in rows for x in r.labels})
    marked = {x: np.array([x in r.labels for r in rows], float) for x in marks}
    visual, tabular = np.array([bool(r.visual) for r in rows], float), np.array([bool(r.tabular) for r in rows], float)
    near: dict[str, np.ndarray] = {}
    for j, r in enumerate(rows):
        for source, nudge in pushed.get(r.query_id, {}).items():
            near.setdefault(source, np.zeros(len(rows)))[j] = nudge
    shared = known.sparkSession.sparkContext.broadcast((asked, first, idf, marked, visual, tabular, near, [r.query_id for r in rows]))

    def scores(pdf: pd.DataFrame) -> np.ndarray:
        """The scores of some documents (rows) for all queries of the block."""
        asked, first, idf, marked, visual, tabular, near, names = shared.value
        term = np.concatenate([np.asarray(t, np.int64) for t in pdf["terms"]])
        f = np.concatenate([np.asarray(c, float) for c in pdf["counts"]])
        doc = np.repeat(np.arange(len(pdf)), [len(t) for t in pdf["terms"]])
        size = pdf["size"].to_numpy(float)[doc]
        w = f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) * idf[term]
        n = first[term + 1] - first[term]
        at = np.repeat(np.arange(len(term)), n)
        query = asked[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + first[term][at]]
        score = np.bincount(doc[at] * len(names) + query, weights=w[at], minlength=len(pdf) * len(names)).astype(float).reshape(len(pdf), len(names))
        for i, own in enumerate(pdf["labels"]):
            hit = [marked[x] for x in own if x in marked]
            if hit:
                score[i] += LABEL_BOOST * np.maximum.reduce(hit)
        for column, wanted in (("visual", visual), ("tabular", tabular)):
            there = pdf[column].to_numpy(bool)
            score[there] += INTENT_BOOST * wanted
        if near:
            for i, source in enumerate(pdf["source_id"]):
                if source in near:
                    score[i] += near[source]
        return np.where(score > 0, score + pdf["extra"].to_numpy(float)[:, None], 0.0).round(6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value[-1]
        best = pd.DataFrame({"query": np.zeros(0, np.int64), "doc_key": pd.Series([], dtype=object), "score": np.zeros(0)})
        least = np.zeros(len(names))  # the score a document must reach to be among the best so far
        for whole in batches:
            for start in range(0, len(whole), BATCH):
                pdf = whole.iloc[start : start + BATCH]
                score = scores(pdf)
                floor = np.partition(score, len(score) - k, axis=0)[len(score) - k] if len(score) > k else np.zeros(len(names))
                doc, query = np.nonzero((score > 0) & (score >= np.maximum(least, floor)))
                if len(doc):
                    more = pd.DataFrame({"query": query, "doc_key": pdf["doc_key"].to_numpy()[doc], "score": score[doc, query]})
                    best = pd.concat([best, more]).sort_values(["query", "score", "doc_key"], ascending=[True, False, True]).groupby("query").head(k)
                    full = best.groupby("query")["score"].agg(["size", "min"])
                    full = full[full["size"] >= k]
                    least[full.index.to_numpy()] = full["min"]
        if len(best):
            yield pd.DataFrame({"query_id": [names[q] for q in best["query"]], "doc_key": best["doc_key"].to_numpy(object), "score": best["score"].to_numpy()})

    return known.mapInPandas(run, f"query_id {types[0]}, doc_key {types[1]}, score double")


def rank_within_sources(queries: DataFrame, documents: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_key, score where each query sees the documents of its own source only.

    ``queries``: query_id, source_id, tokens; ``documents``: doc_key, source_id, tokens. All statistics are those of the
    source: the filter comes before them. What the queries ask for (terms, their frequencies in the sources asked, sizes of
    these sources) is bounded by the stated set of queries and goes to all tasks; so a large source stays spread.
    """
    wanted = queries.select("query_id", "source_id", F.explode(F.array_distinct("tokens")).alias("term"))
    terms = wanted.select("source_id", "term").distinct()
    asked = F.broadcast(terms.select("source_id").distinct())
    sizes = documents.join(asked, "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    counts = documents.select("source_id", "doc_key", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    counts = counts.join(F.broadcast(terms), ["source_id", "term"], "left_semi").groupBy("source_id", "doc_key", "length", "term").agg(F.count("*").alias("f"))
    df = counts.groupBy("source_id", "term").agg(F.count("*").alias("df"))
    f, n, d = F.col("f").cast("double"), F.col("n"), F.col("df")
    weight = F.log(1 + (n - d + 0.5) / (d + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.greatest(F.col("mean"), F.lit(1.0))))
    scored = counts.join(F.broadcast(df), ["source_id", "term"]).join(F.broadcast(sizes), "source_id").select("source_id", "term", "doc_key", weight.alias("w"))
    total = scored.join(F.broadcast(wanted), ["source_id", "term"]).groupBy("query_id", "doc_key").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_rows(total, ["query_id"], [F.desc("score"), "doc_key"], k).select("query_id", "rank", "doc_key", "score")
