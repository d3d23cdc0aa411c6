"""Splitting of oversized texts at natural boundaries, by recursive bisection (problem 5).

A text longer than its limit is cut at the strongest boundary near its middle (paragraph, line, sentence, clause, blank,
then any place that parts no combined character); halves that are still longer than the limit minus the overlap are cut
again, and at last each piece but the first takes the overlap from the text before it.

Defined results: null and empty texts, and texts within their limit, have no pieces; a table without a limit of its own or
``*`` splits nothing; limits and texts are counted in Unicode code points; of re-delivered records the earliest counts; an
overlap that is null, negative or not below the limit counts as 0; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from unicodedata import combining

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.sources.tables import earliest

#: boundaries from strong to weak; the cut lies at the end of the match
BOUNDARIES = (
    ("paragraph", re.compile(r"\n[^\S\n]*\n\s*")),
    ("line", re.compile(r"\n\s*")),
    ("sentence", re.compile(r"[.!?…][\"'”’)\]]*\s+|[。！？!?][”’」』）]*\s*")),
    ("clause", re.compile(r"[;:,，、；：]\s*(?=\D)|\s[–—-]\s+")),
    ("blank", re.compile(r"\s+")),
)
PIECE_SCHEMA = "rec_table string, rec_key string, piece_no int, start int, stop int, overlap int, boundary string, text string, item_ids array<string>"
MOST_LIMITS = 10_000


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, str]]:
    """(position, kind of boundary) of the cuts in text; every body but the first is at most limit - overlap long."""
    room = limit - overlap
    marks = [(name, [p for m in pattern.finditer(text) if 0 < (p := m.end()) < len(text)]) for name, pattern in BOUNDARIES]

    def best(lo: int, hi: int) -> tuple[int, str]:
        middle, reach = (lo + hi) // 2, (hi - lo) // 4
        for name, places in marks:  # near the middle: within the two inner quarters
            i = bisect_left(places, middle)
            near = [p for p in places[max(0, i - 1) : i + 1] if lo < p < hi and abs(p - middle) <= reach]
            if near:
                return min(near, key=lambda p: abs(p - middle)), name
        for name, places in marks:  # else anywhere that leaves both sides something
            i = bisect_left(places, middle)
            near = [p for p in places[max(0, i - 1) : i + 1] if lo + room // 10 < p < hi - room // 10]
            if near:
                return min(near, key=lambda p: abs(p - middle)), name
        p = middle
        while p < hi - 1 and (combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
            p += 1
        return (p if p < hi - 1 else middle), "none"

    out, open_spans = [], [(0, len(text))]
    while open_spans:
        lo, hi = open_spans.pop()
        if hi - lo > (room if lo else limit):
            p, name = best(lo, hi)
            out.append((p, name))
            open_spans += [(lo, p), (p, hi)]
    return sorted(out)


def pieces_of(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, stop, overlap, boundary before) of the pieces; piece text = text[start - overlap : stop]."""
    overlap = overlap if 0 < overlap < limit else 0
    places = [(0, "start"), *cuts(text, limit, overlap)]
    stops = [p for p, _ in places[1:]] + [len(text)]
    return [(a, b, min(overlap, a), name) for (a, name), b in zip(places, stops, strict=True)]


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """rows (rec_table, modality, ...) with max_chars and overlap_chars of their own modality, else of ``*``.

    ``limits`` holds a row per type, at most MOST_LIMITS (checked), and is broadcast: a shuffle on the type would put the
    commonest type into one task.
    """
    if limits.limit(MOST_LIMITS + 1).count() > MOST_LIMITS:
        raise ValueError("size limits must be a small table of types")
    small = limits.where("max_chars > 0").groupBy("rec_table", "modality").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("own"))
    rest = small.where("modality = '*'").select("rec_table", F.col("own").alias("other"))
    joined = rows.join(F.broadcast(small), ["rec_table", "modality"], "left").join(F.broadcast(rest), ["rec_table"], "left")
    return joined.withColumn("limit", F.coalesce("own", "other")).drop("own", "other")


def oversized(table: str, rows: DataFrame, record: str, text: str, modality: Column, item_ids: Column, limits: DataFrame) -> DataFrame:
    """The records over their limit: rec_table, rec_key, text, item_ids, limit. Only long texts are shuffled."""
    typed = rows.select("source_id", record, "ingested_at", F.col(text).alias("text"), F.coalesce(modality, F.lit("*")).alias("modality"), item_ids.alias("item_ids"), F.lit(table).alias("rec_table"))
    judged = with_limits(typed, limits)
    over = F.char_length("text") > F.col("limit.max_chars")
    slim = judged.select("source_id", record, "ingested_at", *[F.when(over, F.col(c)).alias(c) for c in ("text", "item_ids", "limit")])
    first = earliest(slim, ["source_id", record], ["text", "item_ids", "limit"]).where("text is not null")
    return first.select(F.lit(table).alias("rec_table"), F.concat_ws("#", "source_id", record).alias("rec_key"), "text", "item_ids", "limit.max_chars", "limit.overlap_chars")


def split_texts(records: DataFrame) -> DataFrame:
    """PIECE_SCHEMA rows of oversized records; pieces of a chunk keep its item_ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for table, key, text, ids, limit, overlap in batch.itertuples(index=False):
                for n, (a, b, o, name) in enumerate(pieces_of(text, int(limit), int(overlap)), 1):
                    rows.append((table, key, n, a, b, o, name, text[a - o : b], ids))
            yield pd.DataFrame(rows, columns=["rec_table", "rec_key", "piece_no", "start", "stop", "overlap", "boundary", "text", "item_ids"])

    return records.select("rec_table", "rec_key", "text", "item_ids", "max_chars", "overlap_chars").mapInPandas(run, PIECE_SCHEMA)


def project_pieces(items: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of all oversized texts of the two tables."""
    none = F.lit(None).cast("array<string>")
    a = oversized("package_items", items, "item_id", "raw_text", F.col("item_type"), none, limits)
    b = oversized("chunks", chunks, "chunk_id", "text", F.get("modalities", 0), F.col("item_ids"), limits)
    return split_texts(a.unionByName(b))
