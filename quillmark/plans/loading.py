"""Queries of readers, writers and places for models: what they do with rows of the given tables."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions.models import embedder, fill_cache, rerank
from quillmark.operators.context import stretch
from quillmark.operators.evidence import asset_key
from quillmark.plans import retrieval as rt
from quillmark.session import shared_folder
from quillmark.sources import blocks, sinks
from quillmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str):
    def register(query):
        QUERIES[name] = query
        ORACLE[name] = sql
        return query

    return register


# ---- parser blocks ----------------------------------------------------------------------------------------------------
_BLOCK_TYPE = {"title": "text", "paragraph": "text", "page_header": "header", "page_footer": "footer", "page_aside_text": "aside_text"}


def block_lists(spark: SparkSession, folder: str) -> DataFrame:
    """stem, document: the items of each page (in parts of a range of the sequence) as a parser's flat list of blocks."""
    items = rt.items_of(spark, folder, ["sequence", "item_type", "page_start", "raw_text", "caption", "table_html", "latex"])
    kind = F.col("item_type")
    names = F.coalesce(F.create_map(*[F.lit(x) for p in _BLOCK_TYPE.items() for x in p])[kind], kind)
    visual = lambda k: F.when(kind == k, F.array("caption")).alias(f"{k}_caption")
    block = F.struct(
        names.alias("type"), F.when(~kind.isin("image", "figure", "chart", "table", "equation"), F.col("raw_text")).alias("text"), F.when(kind == "title", 1).alias("text_level"), (F.col("page_start") - 1).alias("page_idx"),
        visual("image"), visual("chart"), visual("table"), F.when(kind == "table", F.col("table_html")).alias("table_body"), F.when(kind == "equation", F.col("latex")).alias("latex"),
    )
    stem = F.concat_ws("/", "source_id", F.coalesce(F.col("page_start").cast("string"), F.lit("none")), stretch(F.col("sequence")).cast("string"))
    rows = items.where("item_type is not null").select(stem.alias("stem"), F.struct(F.coalesce("sequence", F.lit(0)).alias("sequence"), "item_id", block.alias("block")).alias("row"))
    grouped = rows.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("row.sequence", "row.item_id", F.to_json("row.block").alias("json")))).alias("rows"))
    return grouped.select("stem", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r.json), ","), F.lit("]")).alias("document"))


@add(
    "block_items",
    f"""WITH {rt.ITEMS}, b AS (SELECT source_id || '/' || coalesce(page_start::VARCHAR, 'none') || '/' || floor(coalesce(sequence, 0) / 500)::INT AS stem, coalesce(page_start, 1) AS page, row_number() OVER w AS n, item_type,
  CASE WHEN item_type = 'equation' THEN trim(coalesce(latex, '')) WHEN item_type IN ('image', 'figure', 'chart', 'table') THEN '' ELSE trim(coalesce(raw_text, '')) END AS body, CASE WHEN item_type IN ('image', 'chart', 'table') THEN trim(coalesce(caption, '')) ELSE '' END AS caption,
  coalesce(last_value(CASE WHEN item_type = 'title' THEN trim(coalesce(raw_text, '')) END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS breadcrumb
  FROM items WHERE item_type IS NOT NULL WINDOW w AS (PARTITION BY source_id, page_start, floor(coalesce(sequence, 0) / 500) ORDER BY coalesce(sequence, 0), item_id))
SELECT stem, printf('item-p%04d-b%04d', page, n) AS item_id, n::INT AS sequence, item_type, breadcrumb, coalesce(nullif(body, ''), caption) AS raw_text, caption, 'content_list[' || (n - 1) || ']' AS raw_ref FROM b""",
)
def block_items(spark, folder):
    """Items written as a parser's block lists and read again."""
    rows = blocks.items_of_blocks(blocks.blocks(block_lists(spark, folder)))
    return rows.select("stem", "item_id", "sequence", "item_type", "breadcrumb", "raw_text", "caption", "raw_ref")


# ---- writers ----------------------------------------------------------------------------------------------------------
def fresh_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"


@add("appended_log", "SELECT event_id, event_type, value IS NULL OR value < 50 AS early FROM events")
def appended_log(spark, folder):
    """A log of all events, appended in two runs."""
    path = fresh_path(spark)
    early = F.coalesce(F.col("value") < 50, F.lit(True))
    rows = table(spark, folder, "events").select("event_id", "event_type", early.alias("early"))
    for own in (rows.where("early"), rows.where("not early")):
        sinks.append_log(own, path)
    return spark.read.schema(rows.schema).parquet(path)


@add("replaced_partitions", "SELECT doc_id, kind, CASE WHEN kind IN ('entity', 'concept') THEN 2 ELSE 1 END AS version FROM documents")
def replaced_partitions(spark, folder):
    """Pages partitioned by kind, of which two kinds are delivered again."""
    path = fresh_path(spark)
    rows = table(spark, folder, "documents").select("doc_id", "kind")
    sinks.replace_partitions(rows.withColumn("version", F.lit(1)), path, ["kind"])
    sinks.replace_partitions(rows.where("kind in ('entity', 'concept')").withColumn("version", F.lit(2)), path, ["kind"])
    return spark.read.parquet(path).select("doc_id", F.col("kind").cast("string").alias("kind"), "version")


# ---- places for models ------------------------------------------------------------------------------------------------
def digest_vectors(texts: list[str]) -> list[list[float]]:
    """A model without weights: the bytes of a text's sha256 as fractions."""
    return [[round(b / 255, 6) for b in hashlib.sha256(t.encode()).digest()] for t in texts]


def shared_letters(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer without weights: the share of a query's letters that a text has."""
    return [round(len(set(q) & set(t)) / max(1, len(set(q))), 6) for q, t in zip(queries, texts, strict=True)]


@add("embedded_questions", f"SELECT id, {rt.sql_embedding('question')} AS vector FROM eval_cases WHERE question IS NOT NULL")
def embedded_questions(spark, folder):
    return rt.cases(spark, folder).where("question is not null").select("id", embedder(digest_vectors)(F.col("question")).alias("vector"))


@add(
    "reranked_hits",
    rt._CHUNK_RANK
    + """, c AS (SELECT query_id, doc_key, list_distinct(string_split(coalesce(question, ''), '')) AS letters, coalesce(text, '') AS text FROM ranked JOIN eval_cases e ON e.id = query_id JOIN cs ON cs.source_id || '#' || cs.chunk_id = doc_key),
s AS (SELECT query_id, doc_key, round(len(list_filter(letters, lambda x: x <> '' AND contains(text, x))) / greatest(1, len(list_filter(letters, lambda x: x <> ''))), 6) AS score FROM c)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank, doc_key, score FROM s QUALIFY rank <= 5""",
)
def reranked_hits(spark, folder):
    """The best hits of each question scored anew as pairs."""
    texts = rt.chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), tx.empty(F.col("text")).alias("text"))
    asked = rt.cases(spark, folder).select(F.col("id").alias("query_id"), tx.empty(F.col("question")).alias("query"))
    pairs = rt.bm25_chunk_topk(spark, folder).select("query_id", "doc_key").join(texts, "doc_key").join(asked, "query_id")
    return rerank(pairs, shared_letters, 5).select("query_id", "rank", "doc_key", "score")


@add(
    "filled_captions",
    "WITH w AS (SELECT lower(trim(sha256)) AS sha256, min(coalesce(path, '')) AS input FROM assets WHERE sha256 IS NOT NULL GROUP BY 1), r AS (SELECT sha256, caption.text AS text FROM visual_cache WHERE caption.status = 'ready') SELECT w.sha256, CASE WHEN r.sha256 IS NOT NULL THEN r.text ELSE 'seen ' || input END AS text, 'ready' AS status FROM w LEFT JOIN r USING (sha256)",
)
def filled_captions(spark, folder):
    """A caption for the bytes of every asset: from the cache, or from the model where that has none ready."""
    wanted = table(spark, folder, "assets").where("sha256 is not null").select(asset_key().alias("sha256"), tx.empty(F.col("path")).alias("input"))
    cache = table(spark, folder, "visual_cache").select("sha256", F.col("caption.text").alias("text"), F.col("caption.status").alias("status"))
    return fill_cache(wanted, cache, "sha256", lambda paths: [f"seen {p}" for p in paths])
