"""Queries of the problems on training text, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import language, leakage, mixing, scans, spam, splitting
from quillmark.session import cut_lineage
from quillmark.sources.tables import table


def _scans(spark: SparkSession, folder: str, repair: bool = False) -> DataFrame:
    return scans.read_scans(*[table(spark, folder, t) for t in ("package_items", "visual_cache", "packages", "assets")], repair=repair)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder).select("rec_table", "rec_key", F.inline("events")).distinct()


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    return _scans(spark, folder, repair=True).select("rec_table", "rec_key", F.col("repaired").alias("text"))


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return language.project_segments(table(spark, folder, "package_items"), table(spark, folder, "chunks"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.label_cases(_segments(spark, folder)).select("rec_table", "rec_key", "seg_no", "lang")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    every = _segments(spark, folder).select("rec_table", "rec_key", "declared", F.posexplode("segments").alias("n", "s"))
    return every.select("rec_table", "rec_key", (F.col("n") + 1).alias("seg_no"), "declared", "s.lang", "s.start", "s.stop", "s.letters", "s.confidence")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.project_pieces(*[table(spark, folder, t) for t in ("package_items", "chunks", "size_limits")])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no = 1").select("rec_table", "rec_key")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_cases(table(spark, folder, "documents"), table(spark, folder, "eval_cases")).select("doc_id", "case_id")


def p6_clean(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.without_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_cases"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _page_features(spark: SparkSession, folder: str) -> DataFrame:
    return cut_lineage(spam.page_features(table(spark, folder, "documents")))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(_page_features(spark, folder)).select("doc_id").distinct()


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.shaped(_page_features(spark, folder))


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired, "p4_found": p4_found, "p4_segments": p4_segments, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_clean": p6_clean}

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_WORDS = lambda x: f"regexp_extract_all(lower(translate({x}, '{_WIDE[0]}', '{_WIDE[1]}')), '[\\p{{L}}\\p{{N}}]+')"

ORACLE = {
    "p6_found": f"""WITH c AS (SELECT DISTINCT id, {_WORDS("text")} AS w FROM (SELECT id, unnest([question, expected_answer]) AS text FROM eval_cases WHERE id IS NOT NULL) WHERE text IS NOT NULL),
f AS (SELECT id, w, array_to_string(w, '') AS s FROM c), g AS (SELECT *, length(regexp_replace(s, '[^㐀-䶿一-鿿豈-﫿]', '', 'g')) * 3 >= greatest(1, length(s)) AS zh FROM f),
passages AS (SELECT id, array_to_string(w[i:i + {leakage.LEAST_WORDS - 1}], ' ') AS p FROM (SELECT id, w, unnest(range(1, len(w) - {leakage.LEAST_WORDS - 2})) AS i FROM g WHERE NOT zh) UNION SELECT id, substr(s, i, {leakage.LEAST_CHARS}) FROM (SELECT id, s, unnest(range(1, length(s) - {leakage.LEAST_CHARS - 2})) AS i FROM g WHERE zh)),
d AS (SELECT doc_id, {_WORDS("text")} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL), e AS (SELECT doc_id, w, array_to_string(w, '') AS s FROM d),
stretches AS (SELECT doc_id, array_to_string(w[i:i + {leakage.LEAST_WORDS - 1}], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - {leakage.LEAST_WORDS - 2})) AS i FROM e) UNION ALL SELECT doc_id, substr(s, i, {leakage.LEAST_CHARS}) FROM (SELECT doc_id, s, unnest(range(1, length(s) - {leakage.LEAST_CHARS - 2})) AS i FROM e))
SELECT DISTINCT doc_id, id AS case_id FROM stretches JOIN passages USING (p)""",
    "p5_found": """WITH recs AS (
  SELECT 'package_items' AS rec_table, source_id || '#' || item_id AS rec_key, arg_min(raw_text, ingested_at) AS text, arg_min(item_type, ingested_at) AS modality FROM package_items GROUP BY source_id, item_id
  UNION ALL SELECT 'chunks', source_id || '#' || chunk_id, arg_min(text, ingested_at), arg_min(modalities[1], ingested_at) FROM chunks GROUP BY source_id, chunk_id)
SELECT r.rec_table, r.rec_key FROM recs r LEFT JOIN size_limits a ON a.rec_table = r.rec_table AND a.modality = r.modality
JOIN size_limits b ON b.rec_table = r.rec_table AND b.modality = '*' WHERE length(r.text) > coalesce(a.max_chars, b.max_chars)""",
}
