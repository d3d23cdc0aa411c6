"""Queries of the retrieval operators over the project's tables, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions import vectors as vx
from quillmark.functions import visual as vis
from quillmark.operators import bm25, context, evaluation, evidence, fusion, graph, index, integrity, nearest, pages, rollups
from quillmark.sources.tables import earliest, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOP = 10
VISUAL_MODALITIES = ["image", "chart", "figure", "image_caption", "image_ocr"]

# ---- SQL shared by the queries ----------------------------------------------------------------------------------------
ITEMS = "items AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, item_id ORDER BY ingested_at) AS rn FROM package_items) WHERE rn = 1)"
CHUNKS = "cs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, chunk_id ORDER BY ingested_at) AS rn FROM chunks) WHERE rn = 1)"
ASSETS = "ast AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, asset_id ORDER BY ingested_at) AS rn FROM assets) WHERE rn = 1)"
PAGES = "nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS rn FROM documents WHERE path IS NOT NULL AND path <> '') WHERE rn = 1)"


def sql_tokens(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return (
        f"list_concat(regexp_extract_all({low}, '[a-z0-9]+(?:[._/@+-][a-z0-9]+)*'), "
        f"flatten(list_transform(regexp_extract_all({low}, '[\\x{{3400}}-\\x{{9fff}}]+'), lambda r: list_transform(range(1, greatest(2, length(r))), lambda i: substr(r, i, 2)))))"
    )


def sql_labels(x: str) -> str:
    latin, signs = r"'(?:^|[^\p{L}\p{N}_])((?:figure|fig\.?|table|equation|eq\.?)\s*[a-z0-9.-]+)'", r"'((?:图|表|公式)\s*[a-z0-9.-]+)'"
    low = f"lower(coalesce({x}, ''))"
    return f"list_distinct(list_concat(regexp_extract_all({low}, {latin}, 1), regexp_extract_all({low}, {signs}, 1)))"


def sql_mentions(x: str, words: tuple[str, str]) -> str:
    return f"regexp_matches(coalesce({x}, ''), '(?i){words[0]}|(?:^|[^a-z0-9_])(?:{words[1]})(?:$|[^a-z0-9_])')"


def sql_intent(x: str) -> str:
    direct = {c: sql_mentions(x, w) for c, w in vis.INTENT.items()}
    anchor = "(" + " OR ".join(direct[c] for c in vis.ANCHORS) + ")"
    has = {c: f"({direct[c]} OR ({anchor} AND {sql_mentions(x, vis.CONTEXT[c])}))" if c in vis.CONTEXT else direct[c] for c in vis.INTENT}
    has["spatial_quantity"] = f"({has['spatial_quantity']} OR (({has['visual_reference']} OR {has['scene']}) AND {sql_mentions(x, vis.COUNTING)}))"
    return "list_filter([" + ", ".join(f"CASE WHEN {h} THEN '{c}' END" for c, h in has.items()) + "], lambda s: s IS NOT NULL)"


def sql_embedding(x: str) -> str:
    return f"list_transform(range(1, 33), lambda i: round(('0x' || substr(sha256(coalesce({x}, '')), 2 * i - 1, 2))::INT / 255.0::DOUBLE, 6))"


def sql_bm25(queries: str, documents: str, k: int = TOP, more: str = "0") -> str:
    """CTEs ending in ``ranked`` (query_id, rank, doc_key, score); queries: q(query_id, toks), documents: d(doc_key, toks)."""
    return f"""q AS ({queries}), d AS ({documents}), n AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d),
qt AS (SELECT DISTINCT query_id, unnest(toks) AS term FROM q), dt AS (SELECT doc_key, size, term, count(*) AS f FROM (SELECT doc_key, len(toks) AS size, unnest(toks) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM dt GROUP BY 1),
w AS (SELECT doc_key, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / greatest(mean, 1))) AS w FROM dt JOIN dfs USING (term), n),
lex AS (SELECT query_id, doc_key, sum(w) AS lex FROM qt JOIN w USING (term) GROUP BY 1, 2),
base AS (SELECT query_id, doc_key, coalesce(lex, 0) + {more} AS raw, d.* EXCLUDE doc_key FROM q CROSS JOIN d LEFT JOIN lex USING (query_id, doc_key)),
ranked AS (SELECT query_id, doc_key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM (SELECT query_id, doc_key, round(raw + extra, 6) AS score FROM base WHERE raw > 0) QUALIFY rank <= {k})"""


def add(name: str, sql: str | None = None):
    def register(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


# ---- frames -----------------------------------------------------------------------------------------------------------
def chunks_of(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    return earliest(table(spark, folder, "chunks"), ["source_id", "chunk_id"], keep)


def items_of(spark: SparkSession, folder: str, keep: list[str] | None = None) -> DataFrame:
    return context.current_items(table(spark, folder, "package_items"), keep)


def assets_of(spark: SparkSession, folder: str, keep: list[str]) -> DataFrame:
    return earliest(table(spark, folder, "assets"), ["source_id", "asset_id"], keep)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_cases")


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    return graph.nodes(table(spark, folder, "documents"))


def questions(spark: SparkSession, folder: str, column: str = "question") -> DataFrame:
    q = F.col(column)
    return cases(spark, folder).select(F.col("id").alias("query_id"), "source_id", tx.tokens(q).alias("tokens"), tx.labels(q).alias("labels"), (F.size(vis.visual_intent(q)) > 0).alias("visual"), vis.table_intent(q).alias("tabular"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks as documents to rank: heading path and text."""
    c = chunks_of(spark, folder, ["breadcrumb", "text", "modalities"])
    whole = F.concat(tx.empty(F.col("breadcrumb")), F.lit("\n"), tx.empty(F.col("text")))
    none = F.array().cast("array<string>")
    return c.select(
        F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), "source_id", tx.tokens(whole).alias("tokens"), tx.labels(whole).alias("labels"),
        F.arrays_overlap(F.coalesce("modalities", none), F.lit(VISUAL_MODALITIES)).alias("visual"), F.coalesce(F.array_contains("modalities", "table"), F.lit(False)).alias("tabular"), F.lit(0.0).alias("extra"),
    ).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("visual", "tabular")})


_CHUNK_DOCS = f"SELECT source_id || '#' || chunk_id AS doc_key, source_id, {sql_tokens('whole')} AS toks, {sql_labels('whole')} AS labs, list_has_any(coalesce(list_filter(modalities, lambda m: m IS NOT NULL), []), ['image','chart','figure','image_caption','image_ocr']) AS vis, list_contains(coalesce(modalities, []), 'table') AS tab, 0.0 AS extra FROM (SELECT *, coalesce(breadcrumb, '') || chr(10) || coalesce(text, '') AS whole FROM cs)"
_QUESTIONS = f"SELECT id AS query_id, source_id AS qsource, {sql_tokens('question')} AS toks, {sql_labels('question')} AS qlabs, len({sql_intent('question')}) > 0 AS qvis, regexp_matches(lower(coalesce(question, '')), '{vis.TABLE_WORDS}') AS qtab FROM eval_cases"
_BOOSTS = "CASE WHEN list_has_any(qlabs, labs) THEN 6 ELSE 0 END + CASE WHEN qvis AND vis THEN 4 ELSE 0 END + CASE WHEN qtab AND tab THEN 4 ELSE 0 END"
_CHUNK_RANK = f"WITH {CHUNKS}, " + sql_bm25(_QUESTIONS, _CHUNK_DOCS, more=_BOOSTS)


# ---- tokens and ranking -----------------------------------------------------------------------------------------------
@add("tokenize_bag", f"WITH {CHUNKS} SELECT source_id, chunk_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT source_id, chunk_id, {sql_tokens('text')} AS t FROM cs)")
def tokenize_bag(spark, folder):
    t = tx.tokens(F.col("text"))
    return chunks_of(spark, folder, ["text"]).select("source_id", "chunk_id", t.alias("t")).select("source_id", "chunk_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@add("term_statistics", f"WITH {CHUNKS} SELECT term, count(*) AS occurrences, count(DISTINCT k) AS documents FROM (SELECT source_id || '#' || chunk_id AS k, unnest({sql_tokens('text')}) AS term FROM cs) GROUP BY 1")
def term_statistics(spark, folder):
    each = chunks_of(spark, folder, ["text"]).select("source_id", "chunk_id", F.explode(tx.tokens(F.col("text"))).alias("term"))
    per = each.groupBy("source_id", "chunk_id", "term").agg(F.count("*").alias("f"))
    return per.groupBy("term").agg(F.sum("f").alias("occurrences"), F.count("*").alias("documents"))


@add("bm25_chunk_topk", _CHUNK_RANK + " SELECT query_id, rank, doc_key, score FROM ranked")
def bm25_chunk_topk(spark, folder):
    return bm25.rank_documents(questions(spark, folder), chunk_documents(spark, folder), TOP)


@add(
    "bm25_source_filtered",
    f"""WITH {CHUNKS}, q AS ({_QUESTIONS}), d AS ({_CHUNK_DOCS}), n AS (SELECT source_id, count(*) AS n, avg(len(toks)) AS mean FROM d GROUP BY 1),
qt AS (SELECT DISTINCT query_id, qsource AS source_id, unnest(toks) AS term FROM q), dt AS (SELECT source_id, doc_key, size, term, count(*) AS f FROM (SELECT source_id, doc_key, len(toks) AS size, unnest(toks) AS term FROM d) GROUP BY ALL),
dfs AS (SELECT source_id, term, count(*) AS df FROM dt GROUP BY 1, 2),
s AS (SELECT query_id, doc_key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / greatest(mean, 1)))), 6) AS score FROM qt JOIN dt USING (source_id, term) JOIN dfs USING (source_id, term) JOIN n USING (source_id) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank, doc_key, score FROM s QUALIFY rank <= {TOP}""",
)
def bm25_source_filtered(spark, folder):
    return bm25.rank_within_sources(questions(spark, folder), chunk_documents(spark, folder), TOP)


_ALIASES = """bare AS (SELECT *, regexp_replace(path, '\\.md$', '') AS b FROM nodes),
names AS (SELECT alias, arg_min(path, doc_id) AS path, count(DISTINCT path) > 1 AS ambiguous FROM (SELECT DISTINCT path, doc_id, lower(unnest([b, regexp_extract(b, '([^/]*)$', 1), coalesce(title, '')])) AS alias FROM bare) WHERE alias <> '' GROUP BY 1),
raw AS (SELECT DISTINCT path AS source, regexp_replace(trim(l), '\\.md$', '') AS link FROM (SELECT path, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[^!])\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?(?:\\|[^\\]]*)?\\]\\]', 1)) AS l FROM nodes) WHERE regexp_replace(trim(l), '\\.md$', '') <> '')"""
_LINKS = f"{PAGES}, {_ALIASES}, found AS (SELECT source, link, CASE WHEN NOT ambiguous THEN path END AS target FROM raw LEFT JOIN names ON alias = lower(link)), edges AS (SELECT DISTINCT source, target FROM found WHERE target IS NOT NULL AND target <> source)"
_LOOSE = f"{PAGES}, {_ALIASES}, found AS (SELECT source, link, path AS target FROM raw LEFT JOIN names ON alias = lower(link)), edges AS (SELECT DISTINCT source, target FROM found WHERE target IS NOT NULL AND target <> source)"
_PAGE_DOCS = f"""SELECT (CASE WHEN kind = 'source' THEN '1' ELSE '0' END) || path AS doc_key, list_concat(tt, tt, tt, tt, {sql_tokens('text')}) AS toks, {sql_labels("coalesce(title, '') || chr(10) || coalesce(text, '')")} AS labs, 0.15 * ln(1 + coalesce(inbound, 0)) AS extra
FROM (SELECT *, {sql_tokens('title')} AS tt FROM nodes) LEFT JOIN (SELECT target AS path, count(*) AS inbound FROM edges GROUP BY 1) USING (path)"""


def ranked_pages(spark, folder, column="question", k=TOP):
    nodes = pages_of(spark, folder)
    found = graph.links(nodes, graph.aliases(nodes), strict=False)
    power = graph.authority(nodes, found).select("path", (F.lit(0.15) * F.log1p("inbound")).alias("extra"))
    title = tx.tokens(F.col("title"))
    whole = F.concat(tx.empty(F.col("title")), F.lit("\n"), tx.empty(F.col("text")))
    docs = nodes.join(power, "path").select(
        F.concat(F.when(F.col("kind") == "source", "1").otherwise("0"), F.col("path")).alias("doc_key"), F.concat(title, title, title, title, tx.tokens(F.col("text"))).alias("tokens"), tx.labels(whole).alias("labels"), F.lit(False).alias("visual"), F.lit(False).alias("tabular"), "extra"
    )
    hits = bm25.rank_documents(questions(spark, folder, column), docs, k)
    return hits.select("query_id", "rank", F.substring("doc_key", F.lit(2), F.length("doc_key") - 1).alias("path"), "score")


@add("bm25_page_topk", f"WITH {_LOOSE}, " + sql_bm25(_QUESTIONS, _PAGE_DOCS, more="CASE WHEN list_has_any(qlabs, labs) THEN 6 ELSE 0 END") + " SELECT query_id, rank, substr(doc_key, 2) AS path, score FROM ranked")
def bm25_page_topk(spark, folder):
    return ranked_pages(spark, folder)


@add("query_intent", f"SELECT id, {sql_intent('question')} AS categories, {sql_labels('question')} AS labels, regexp_matches(lower(coalesce(question, '')), '{vis.TABLE_WORDS}') AS tabular, {sql_mentions('question', vis.AGGREGATION)} AS aggregating FROM eval_cases")
def query_intent(spark, folder):
    q = F.col("question")
    return cases(spark, folder).select("id", vis.visual_intent(q).alias("categories"), tx.labels(q).alias("labels"), vis.table_intent(q).alias("tabular"), vis.aggregation_intent(q).alias("aggregating"))


@add(
    "hit_snippets",
    _CHUNK_RANK
    + f""", h AS (SELECT ranked.query_id, rank, doc_key, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS clean, {sql_tokens('question')} AS toks FROM ranked JOIN eval_cases e ON e.id = query_id JOIN cs ON cs.source_id || '#' || cs.chunk_id = doc_key),
p AS (SELECT *, greatest(0, coalesce(list_min(list_filter(list_transform(toks, lambda t: instr(lower(clean), t)), lambda p: p > 0)), 1) - 1 - 166) AS start FROM h)
SELECT query_id, rank, doc_key, CASE WHEN length(clean) <= 500 THEN clean ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END) || substr(clean, start + 1, 500) || (CASE WHEN start + 500 < length(clean) THEN '…' ELSE '' END) END AS snippet FROM p""",
)
def hit_snippets(spark, folder):
    hits = bm25_chunk_topk(spark, folder).join(cases(spark, folder).select(F.col("id").alias("query_id"), tx.tokens(F.col("question")).alias("tokens")), "query_id")
    texts = chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), tx.collapse(F.col("text")).alias("clean"))
    return hits.join(texts, "doc_key").select("query_id", "rank", "doc_key", tx.excerpt(F.col("clean"), F.col("tokens")).alias("snippet"))


@add("content_classes", "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_classes(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@add("document_hashes", f"WITH {CHUNKS} SELECT c.source_id, c.chunk_id, sha256(array_to_string(list_filter([coalesce(p.title, ''), coalesce(c.breadcrumb, ''), coalesce(c.text, '')], lambda s: s <> ''), chr(10))) AS content_hash, p.source_version FROM cs c LEFT JOIN packages p ON p.package_id = c.source_id")
def document_hashes(spark, folder):
    return index.index_records(chunks_of(spark, folder, ["breadcrumb", "text"]), table(spark, folder, "packages")).select("source_id", "chunk_id", "content_hash", "source_version")


# ---- vectors and fusion -----------------------------------------------------------------------------------------------
_COSINE = "c AS (SELECT a.vec_id AS query_id, b.vec_id, b.label AS source_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


def vector_hits(spark, folder, k):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return nearest.nearest(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e, k)


@add("cosine_topk", f"WITH {_COSINE} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM c QUALIFY rank <= {TOP}")
def cosine_topk(spark, folder):
    return vector_hits(spark, folder, TOP)


_TOP50 = f"WITH {_COSINE}, t AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50)"


def labelled_hits(spark, folder):
    return vector_hits(spark, folder, 50).join(table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("source_id")), "vec_id")


@add("source_mean_top3", _TOP50 + ", m AS (SELECT query_id, source_id, round(avg(score), 6) AS score FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY query_id, source_id ORDER BY score DESC, vec_id) <= 3) GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank, source_id, score FROM m QUALIFY rank <= 8")
def source_mean_top3(spark, folder):
    return nearest.mean_of_best(labelled_hits(spark, folder))


@add("source_candidates", _TOP50 + ", m AS (SELECT query_id, source_id, max(score) AS best, count(*) AS hits FROM t GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, hits DESC, source_id) AS rank, source_id, best, hits FROM m QUALIFY rank <= 5")
def source_candidates(spark, folder):
    return rollups.candidate_sources(labelled_hits(spark, folder)).select("query_id", "rank", "source_id", "best", "hits")


@add("hash_embedding", f"SELECT id, {sql_embedding('question')} AS vector FROM eval_cases")
def hash_embedding(spark, folder):
    return cases(spark, folder).select("id", vx.hash_embedding(F.col("question")).alias("vector"))


def embedded_hits(spark, folder, k):
    docs = chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("vec_id"), vx.hash_embedding(F.col("text")).alias("vector"))
    asked = cases(spark, folder).select(F.col("id").alias("query_id"), vx.hash_embedding(F.col("question")).alias("vector"))
    return nearest.nearest(asked, docs, k, skip_self=False).select("query_id", "rank", F.col("vec_id").alias("doc_key"), "score")


_EMBEDDED = f"ev AS (SELECT source_id || '#' || chunk_id AS doc_key, {sql_embedding('text')} AS v FROM cs), eq AS (SELECT id AS query_id, {sql_embedding('question')} AS v FROM eval_cases), es AS (SELECT query_id, doc_key, round(list_cosine_similarity(eq.v, ev.v), 6) AS score FROM eq, ev), er AS (SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank FROM es QUALIFY rank <= 20)"


@add(
    "rrf_fuse",
    f"WITH {CHUNKS}, " + sql_bm25(_QUESTIONS, _CHUNK_DOCS, k=20, more=_BOOSTS) + f""", {_EMBEDDED},
f AS (SELECT query_id, doc_key, round(sum(1.0::DOUBLE / (60 + rank)) * 1000, 6) AS score, list(channel ORDER BY channel DESC) AS channels FROM (SELECT query_id, doc_key, rank, 'lexical' AS channel FROM ranked UNION ALL SELECT query_id, doc_key, rank, 'embedding' FROM er) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank, doc_key, score, channels FROM f QUALIFY rank <= {TOP}""",
)
def rrf_fuse(spark, folder):
    lists = {"lexical": bm25.rank_documents(questions(spark, folder), chunk_documents(spark, folder), 20), "embedding": embedded_hits(spark, folder, 20)}
    return fusion.fuse(lists, "doc_key", TOP)


@add(
    "rrf_sources",
    f"WITH {CHUNKS}, " + sql_bm25(_QUESTIONS, _CHUNK_DOCS, k=20, more=_BOOSTS) + f""", {_EMBEDDED},
a AS (SELECT query_id, split_part(doc_key, '#', 1) AS source_id, min(rank) AS rank FROM ranked GROUP BY 1, 2), b AS (SELECT query_id, split_part(doc_key, '#', 1) AS source_id, min(rank) AS rank FROM er GROUP BY 1, 2),
f AS (SELECT query_id, source_id, round(sum(1.0::DOUBLE / (60 + rank)) * 1000, 6) AS score, list(channel ORDER BY channel DESC) AS channels FROM (SELECT *, 'lexical' AS channel FROM a UNION ALL SELECT *, 'embedding' FROM b) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_id) AS rank, source_id, score, channels FROM f QUALIFY rank <= 3""",
)
def rrf_sources(spark, folder):
    first = lambda df: df.groupBy("query_id", F.substring_index("doc_key", "#", 1).alias("source_id")).agg(F.min("rank").alias("rank"))
    lists = {"lexical": first(bm25.rank_documents(questions(spark, folder), chunk_documents(spark, folder), 20)), "embedding": first(embedded_hits(spark, folder, 20))}
    return fusion.fuse(lists, "source_id", 3)


@add(
    "variant_merge_best",
    f"WITH {CHUNKS}, " + sql_bm25(_QUESTIONS.replace("question", "expected_answer").replace("id AS query_id", "id || '/answer' AS query_id") + " UNION ALL " + _QUESTIONS.replace("id AS query_id", "id || '/question' AS query_id"), _CHUNK_DOCS, k=20, more=_BOOSTS) + f""",
m AS (SELECT split_part(query_id, '/', 1) AS query_id, doc_key, max(score) AS score FROM ranked GROUP BY 1, 2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_key) AS rank, doc_key, score FROM m QUALIFY rank <= {TOP}""",
)
def variant_merge_best(spark, folder):
    asked = [questions(spark, folder, c).withColumn("query_id", F.concat("query_id", F.lit(f"/{n}"))) for c, n in (("question", "question"), ("expected_answer", "answer"))]
    hits = bm25.rank_documents(asked[0].unionByName(asked[1]), chunk_documents(spark, folder), 20)
    return fusion.best_of_variants(hits.withColumn("query_id", F.substring_index("query_id", "/", 1)), "doc_key", TOP)


# ---- places and context -----------------------------------------------------------------------------------------------
_PLACED = f"{ITEMS}, placed AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(sequence, 0), item_id) AS position FROM items)"
_PARTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in context.PART_NAMES.items())
_LOCATED = f"""{ITEMS}, l AS (SELECT *, CASE WHEN page_start >= 1 THEN page_start END AS page_number, item_type IN ('paragraph', 'page_aside_text', 'page_footnote') AS para, coalesce(provenance.raw_ref, '') AS ref FROM items),
loc AS (SELECT source_id, item_id, item_type, page_number,
 CASE WHEN page_number IS NOT NULL THEN coalesce(CASE WHEN regexp_matches(ref, '\\[(\\d+)\\]\\[(\\d+)\\]') THEN regexp_extract(ref, '\\[(\\d+)\\]\\[(\\d+)\\]', 1)::INT END, CASE WHEN regexp_matches(item_id, '-p(\\d+)-b(\\d+)$') THEN greatest(0, regexp_extract(item_id, '-p(\\d+)-b(\\d+)$', 1)::INT - 1) END, page_number - 1) END AS page_index,
 CASE WHEN page_number IS NOT NULL THEN coalesce(CASE WHEN regexp_matches(ref, '\\[(\\d+)\\]\\[(\\d+)\\]') THEN regexp_extract(ref, '\\[(\\d+)\\]\\[(\\d+)\\]', 2)::INT + 1 END, CASE WHEN regexp_matches(item_id, '-p(\\d+)-b(\\d+)$') THEN greatest(0, regexp_extract(item_id, '-p(\\d+)-b(\\d+)$', 2)::INT - 1) + 1 END, row_number() OVER w) END AS block_index,
 CASE WHEN page_number IS NOT NULL AND para THEN count(*) FILTER (para) OVER w END AS paragraph_index
 FROM l WINDOW w AS (PARTITION BY source_id, page_number ORDER BY coalesce(sequence, 0), item_id ROWS UNBOUNDED PRECEDING))"""


@add("item_locators", f"WITH {_LOCATED} SELECT *, CASE WHEN page_number IS NOT NULL THEN '第 ' || page_number || ' 页 · ' || CASE WHEN paragraph_index IS NOT NULL THEN '第 ' || paragraph_index || ' 段' ELSE coalesce(CASE item_type {_PARTS} END, '第 ' || block_index || ' 个内容块') END END AS label FROM loc")
def item_locators(spark, folder):
    return context.locators(items_of(spark, folder))


@add("locator_stats", f"WITH {_LOCATED} SELECT source_id, count(*) AS items, count(page_number) AS located, count(paragraph_index) AS paragraphs, round(count(page_number) / count(*), 6) AS coverage FROM loc GROUP BY 1")
def locator_stats(spark, folder):
    loc = item_locators(spark, folder)
    return loc.groupBy("source_id").agg(F.count("*").alias("items"), F.count("page_number").alias("located"), F.count("paragraph_index").alias("paragraphs"), F.round(F.count("page_number") / F.count("*"), 6).alias("coverage"))


@add("item_relations", f"WITH {_PLACED} SELECT source_id, position, item_id, lag(item_id) OVER w AS previous_item_id, lead(item_id) OVER w AS next_item_id FROM placed WINDOW w AS (PARTITION BY source_id ORDER BY position)")
def item_relations(spark, folder):
    return context.relations(context.placed_items(items_of(spark, folder)))


_TEXT = "coalesce(nullif(raw_text, ''), nullif(caption, ''), search_text, '')"


@add("neighbour_context", f"WITH {_PLACED} SELECT a.source_id, a.item_id, b.item_id AS neighbour_id, (b.position - a.position)::INT AS side FROM placed a JOIN placed b ON a.source_id = b.source_id AND abs(a.position - b.position) = 1 AND a.page_start IS NOT DISTINCT FROM b.page_start AND coalesce(a.breadcrumb, '') = coalesce(b.breadcrumb, '') WHERE length(trim({_TEXT.replace('raw_text', 'a.raw_text').replace('caption', 'a.caption').replace('search_text', 'a.search_text')})) <= 80")
def neighbour_context(spark, folder):
    return context.neighbours(context.placed_items(items_of(spark, folder)))


@add("section_members", f"WITH {ITEMS} SELECT sha256(source_id || chr(10) || coalesce(page_start::VARCHAR, '') || chr(10) || coalesce(breadcrumb, '')) AS section_id, source_id, item_id, count(*) OVER (PARTITION BY source_id, page_start, coalesce(breadcrumb, '')) AS members FROM items")
def section_members(spark, folder):
    return context.sections(items_of(spark, folder, ["page_start", "breadcrumb"]))


_SECTION = "coalesce({0}.breadcrumb, '')"


@add(
    "visual_context",
    f"""WITH {_PLACED}, v AS (SELECT * FROM placed WHERE item_type IN ('image', 'figure', 'chart', 'table')), o AS (SELECT *, trim(coalesce(raw_text, '')) AS text FROM placed WHERE coalesce(item_type, '') NOT IN ('image', 'figure', 'chart', 'table', 'equation', 'title') AND trim(coalesce(raw_text, '')) <> ''),
near AS (SELECT v.source_id, v.item_id, o.item_id AS other, o.position AS spot, o.text, coalesce(sum(length(o.text)) OVER (PARTITION BY v.source_id, v.item_id ORDER BY o.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM v JOIN o ON o.source_id = v.source_id AND o.position <> v.position AND o.position BETWEEN v.position - 3 AND v.position + 3 AND o.page_start IS NOT DISTINCT FROM v.page_start
  AND ({_SECTION.format('v')} = '' OR {_SECTION.format('o')} = '' OR {_SECTION.format('v')} = {_SECTION.format('o')})),
taken AS (SELECT source_id, item_id, list(other ORDER BY spot) AS ids, string_agg(substr(text, 1, 1200 - used), ' ' ORDER BY spot) AS context FROM near WHERE used < 1200 GROUP BY 1, 2)
SELECT v.source_id, v.item_id, coalesce(ids, []) AS context_item_ids, coalesce(context, '') AS context FROM v LEFT JOIN taken t ON t.source_id = v.source_id AND t.item_id = v.item_id""",
)
def visual_context(spark, folder):
    return context.visual_context(context.placed_items(items_of(spark, folder)))


@add(
    "heading_paths",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, n, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(line, '^#+', ''), ' ') AS title, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i FROM l WHERE regexp_matches(line, '^#{1,6}(\\s|$)')),
walk AS (SELECT doc_id, i, n, CASE WHEN title <> '' THEN [title] ELSE [] END AS stack FROM h WHERE i = 1
  UNION ALL SELECT h.doc_id, h.i, h.n, list_concat(stack[1:level - 1], CASE WHEN title <> '' THEN [title] ELSE [] END) FROM walk JOIN h ON h.doc_id = walk.doc_id AND h.i = walk.i + 1)
SELECT doc_id, n::INT AS line_no, array_to_string(stack, ' > ') AS path FROM walk""",
)
def heading_paths(spark, folder):
    return context.heading_paths(table(spark, folder, "documents").select("doc_id", "text"))


@add(
    "evidence_selection",
    _CHUNK_RANK.replace(f"WITH {CHUNKS}", f"WITH {CHUNKS}, {_PLACED}", 1)
    + f""", pl AS (SELECT source_id, item_id, position, page_start, coalesce(breadcrumb, '') AS section, length(trim({_TEXT})) AS size, row_number() OVER (PARTITION BY source_id, page_start, coalesce(breadcrumb, '') ORDER BY position) AS nth FROM placed),
hit AS (SELECT query_id, rank, c.source_id, unnest(c.item_ids) AS item_id, generate_subscripts(c.item_ids, 1) - 1 AS spot, {sql_mentions('question', vis.AGGREGATION)} AS agg FROM ranked JOIN cs c ON c.source_id || '#' || c.chunk_id = doc_key JOIN eval_cases e ON e.id = query_id),
direct AS (SELECT hit.*, position, page_start, section, size FROM hit JOIN pl USING (source_id, item_id)),
every AS (SELECT query_id, agg, source_id, item_id, 'hit' AS origin, 0 AS phase, rank, spot, 0 AS minor FROM direct
  UNION ALL SELECT d.query_id, agg, d.source_id, b.item_id, 'adjacent', 0, rank, spot, CASE WHEN b.position < d.position THEN 1 ELSE 2 END FROM direct d JOIN pl b ON b.source_id = d.source_id AND abs(b.position - d.position) = 1 AND b.page_start IS NOT DISTINCT FROM d.page_start AND b.section = d.section WHERE d.size <= 80
  UNION ALL SELECT d.query_id, agg, d.source_id, b.item_id, 'same_page', 1, rank, spot, b.position FROM direct d JOIN pl b ON b.source_id = d.source_id AND b.page_start IS NOT DISTINCT FROM d.page_start AND b.section = d.section WHERE agg AND nth <= 36),
once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id, source_id, item_id ORDER BY phase, rank, spot, minor, origin) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, rank, spot, minor, source_id, item_id) AS place FROM once)
SELECT query_id, place, source_id, item_id, origin FROM numbered WHERE place <= CASE WHEN agg THEN 12 ELSE 8 END""",
)
def evidence_selection(spark, folder):
    hits = bm25_chunk_topk(spark, folder)
    linked = chunks_of(spark, folder, ["item_ids"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), "source_id", "item_ids")
    asked = cases(spark, folder).select(F.col("id").alias("query_id"), vis.aggregation_intent(F.col("question")).alias("aggregating"))
    return context.select_evidence(hits.join(linked, "doc_key").join(asked, "query_id"), context.placed_items(items_of(spark, folder)))


# ---- assets and derived evidence --------------------------------------------------------------------------------------
_DERIVED = f"{ASSETS}, slim AS (SELECT DISTINCT source_id, asset_id, lower(trim(sha256)) AS sha256 FROM ast), derived AS (SELECT source_id, asset_id, kind, text, status, model, status = 'ready' AND trim(coalesce(text, '')) <> '' AS searchable FROM slim JOIN (SELECT sha256, 'image_caption' AS kind, caption.text AS text, caption.status AS status, caption.model AS model FROM visual_cache UNION ALL SELECT sha256, 'image_ocr', ocr.text, ocr.status, ocr.model FROM visual_cache) USING (sha256) WHERE status IS NOT NULL)"


def derived_of(spark, folder):
    return evidence.derived_records(assets_of(spark, folder, ["sha256"]), table(spark, folder, "visual_cache"))


@add("derived_evidence", f"WITH {_DERIVED} SELECT * FROM derived")
def derived_evidence(spark, folder):
    return derived_of(spark, folder)


@add("searchable_units", f"WITH {_DERIVED}, {CHUNKS} SELECT source_id, chunk_id AS unit_id, coalesce(modalities[1], 'text') AS modality, text FROM cs UNION ALL SELECT source_id, asset_id || '-' || kind, kind, text FROM derived WHERE searchable")
def searchable_units(spark, folder):
    return evidence.searchable_units(chunks_of(spark, folder, ["modalities", "text"]), derived_of(spark, folder))


@add("derived_status", "SELECT kind, coalesce(nullif(status, ''), 'missing') AS status, count(*) AS records FROM (SELECT 'caption' AS kind, caption.status AS status FROM visual_cache UNION ALL SELECT 'ocr', ocr.status FROM visual_cache) GROUP BY 1, 2")
def derived_status(spark, folder):
    each = table(spark, folder, "visual_cache").select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.nullif(F.col(f"{k}.status"), F.lit("")), F.lit("missing")).alias("status")) for k in ("caption", "ocr")])))
    return each.groupBy("kind", "status").agg(F.count("*").alias("records"))


@add(
    "asset_parents",
    f"""WITH {ITEMS}, {CHUNKS}, a AS (SELECT source_id, asset_id, count(*) AS items, min(page) AS first_page, max(page) AS last_page FROM (SELECT source_id, page_start AS page, unnest(list_distinct(asset_ids)) AS asset_id FROM items) WHERE asset_id IS NOT NULL GROUP BY 1, 2),
b AS (SELECT source_id, asset_id, count(*) AS chunks FROM (SELECT source_id, unnest(list_distinct(asset_ids)) AS asset_id FROM cs) WHERE asset_id IS NOT NULL GROUP BY 1, 2)
SELECT source_id, asset_id, coalesce(items, 0) AS items, coalesce(chunks, 0) AS chunks, first_page, last_page FROM a FULL JOIN b USING (source_id, asset_id)""",
)
def asset_parents(spark, folder):
    return evidence.asset_parents(items_of(spark, folder, ["asset_ids", "page_start"]), chunks_of(spark, folder, ["asset_ids"]))


@add("hit_assets", f"WITH {CHUNKS}, {ASSETS}, e AS (SELECT source_id, chunk_id, unnest(asset_ids) AS asset_id, generate_subscripts(asset_ids, 1) AS place FROM cs) SELECT e.source_id, chunk_id, list(vault_path ORDER BY place) AS asset_paths FROM e JOIN ast USING (source_id, asset_id) WHERE coalesce(vault_path, '') <> '' GROUP BY 1, 2")
def hit_assets(spark, folder):
    return evidence.hit_assets(chunks_of(spark, folder, ["asset_ids"]), assets_of(spark, folder, ["vault_path"]))


@add("first_captions", f"WITH {ITEMS}, {ASSETS}, c AS (SELECT source_id, item_id, sequence, caption, unnest(asset_ids) AS asset_id FROM items WHERE trim(coalesce(caption, '')) <> '') SELECT sha256, caption FROM (SELECT lower(trim(sha256)) AS sha256, caption, row_number() OVER (PARTITION BY lower(trim(sha256)) ORDER BY source_id, sequence, item_id) AS rn FROM c JOIN ast USING (source_id, asset_id) WHERE sha256 IS NOT NULL) WHERE rn = 1")
def first_captions(spark, folder):
    return evidence.first_captions(items_of(spark, folder, ["sequence", "caption", "asset_ids"]), assets_of(spark, folder, ["sha256"]))


@add("image_payload", f"WITH {ITEMS}, {ASSETS}, e AS (SELECT source_id, item_id, sequence, unnest(asset_ids) AS asset_id FROM items), p AS (SELECT e.source_id, coalesce(nullif(vault_path, ''), path, '') AS path, item_id, sequence FROM e JOIN ast USING (source_id, asset_id) WHERE media_type LIKE 'image/%') SELECT source_id, path, item_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id, path ORDER BY sequence, item_id) AS rn FROM p WHERE path <> '') WHERE rn = 1")
def image_payload(spark, folder):
    return evidence.image_payload(items_of(spark, folder, ["sequence", "asset_ids"]), assets_of(spark, folder, ["media_type", "vault_path", "path"]))


_KIND, _META = "lower(trim(coalesce(item_type, '')))", lambda k: f"nullif(coalesce(metadata['{k}'], ''), '')"
_PLAN_ROW = lambda a, b, c, d, e: f"{{'resource_type': '{a}', 'primary_representation': '{b}', 'run_caption': {c}, 'run_ocr': {d}, 'ocr_policy': {e}}}"
_NATURAL = _PLAN_ROW("natural_image", "vlm_caption", "true", "texty", "CASE WHEN texty THEN 'always' ELSE 'on_demand' END")
_PAGE_SHOT, _TABLE_SHOT = _PLAN_ROW("page_screenshot", "ocr+vlm_caption", "true", "true", "'always'"), _PLAN_ROW("table_screenshot", "structured_table", "false", "true", "'assistive'")


@add(
    "reading_plans",
    f"""WITH {ITEMS}, v AS (SELECT source_id, item_id, {_KIND} AS kind, lower(trim(coalesce({_META('visual_type')}, {_META('resource_type')}, {_META('image_type')}, ''))) AS declared, lower(concat_ws(' ', coalesce(caption, ''), coalesce(breadcrumb, ''))) AS about,
  coalesce(len(table_rows), 0) > 0 OR coalesce(table_html, '') <> '' AS tabled, coalesce(latex, '') <> '' AS formula, {_META('ocr_required')} IS NOT NULL OR {_META('contains_text')} IS NOT NULL OR {_META('text_dense')} IS NOT NULL AS texty FROM items WHERE item_type IN ('image', 'figure', 'chart', 'table', 'equation')),
e AS (SELECT *, CASE WHEN declared <> '' THEN declared ELSE kind END AS effective FROM v),
p AS (SELECT source_id, item_id, CASE WHEN effective IN ('equation', 'formula', 'formula_screenshot') OR formula THEN {_PLAN_ROW('formula', 'latex', 'false', 'false', "'disabled'")}
  WHEN kind = 'table' OR tabled OR effective IN ('table', 'table_screenshot', 'table-image') THEN {_TABLE_SHOT} WHEN effective IN ('page', 'page_image', 'page_screenshot', 'screenshot') THEN {_PAGE_SHOT}
  WHEN declared IN ('natural', 'natural_image', 'photo', 'scene') THEN {_NATURAL} WHEN {sql_mentions('about', vis.PAGE_SHOT)} THEN {_PAGE_SHOT} WHEN {sql_mentions('about', vis.TABLE_SHOT)} THEN {_TABLE_SHOT}
  WHEN effective IN ('chart', 'plot', 'diagram', 'flowchart', 'flow_chart', 'architecture_diagram') OR kind = 'chart' OR {sql_mentions('about', vis.DIAGRAM)} THEN {_PLAN_ROW('diagram_chart', 'ocr+vlm_caption', 'true', 'true', "'always'")} ELSE {_NATURAL} END AS plan FROM e)
SELECT source_id, item_id, plan.resource_type, plan.primary_representation, plan.run_caption, plan.run_ocr, plan.ocr_policy FROM p""",
)
def reading_plans(spark, folder):
    i = items_of(spark, folder, ["item_type", "table_rows", "table_html", "latex", "caption", "breadcrumb", "metadata"])
    visual = i.where(F.col("item_type").isin("image", "figure", "chart", "table", "equation"))
    has_table = (F.coalesce(F.size("table_rows"), F.lit(0)) > 0) | (tx.empty(F.col("table_html")) != "")
    plan = vis.reading_plan(F.col("item_type"), has_table, tx.empty(F.col("latex")) != "", F.col("caption"), F.col("breadcrumb"), F.col("metadata"))
    return visual.select("source_id", "item_id", plan.alias("plan")).select("source_id", "item_id", "plan.*")


# ---- integrity --------------------------------------------------------------------------------------------------------
@add("duplicate_keys", "SELECT 'package_items' AS source, source_id || '#' || item_id AS key, count(*) AS copies FROM package_items GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'chunks', source_id || '#' || chunk_id, count(*) FROM chunks GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'assets', source_id || '#' || asset_id, count(*) FROM assets GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, folder):
    one = lambda t, k: integrity.duplicate_keys(table(spark, folder, t), ["source_id", k]).select(F.lit(t).alias("source"), F.concat_ws("#", "source_id", k).alias("key"), "copies")
    return one("package_items", "item_id").unionByName(one("chunks", "chunk_id")).unionByName(one("assets", "asset_id"))


@add("asset_conflicts", "SELECT asset_id, min(lower(trim(sha256))) AS lowest, max(lower(trim(sha256))) AS highest FROM assets GROUP BY 1 HAVING lowest <> highest")
def asset_conflicts(spark, folder):
    return integrity.conflicting_values(table(spark, folder, "assets"), ["asset_id"], evidence.asset_key())


_FK = (("lineitem", "orders", {"l_orderkey": "o_orderkey"}), ("lineitem", "part", {"l_partkey": "p_partkey"}), ("lineitem", "supplier", {"l_suppkey": "s_suppkey"}), ("orders", "customer", {"o_custkey": "c_custkey"}), ("customer", "nation", {"c_nationkey": "n_nationkey"}), ("supplier", "nation", {"s_nationkey": "n_nationkey"}), ("nation", "region", {"n_regionkey": "r_regionkey"}), ("documents", "packages", {"package_id": "package_id"}), ("eval_cases", "packages", {"source_id": "package_id"}))


@add("missing_parents", " UNION ALL ".join(f"SELECT '{c}->{p}' AS \"check\", count(*) AS rows, count(DISTINCT {k}) AS distinct_keys FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {v} FROM {p} WHERE {v} IS NOT NULL)" for c, p, on in _FK for k, v in on.items()))
def missing_parents(spark, folder):
    out = None
    for child, parent, on in _FK:
        one = integrity.missing_parents(table(spark, folder, child), table(spark, folder, parent), on, f"{child}->{parent}")
        out = one if out is None else out.unionByName(one)
    return out


@add("source_coverage", "SELECT count(*) AS sources, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / count(*), 4) AS rate FROM (SELECT package_id IN (SELECT package_id FROM documents WHERE package_id IS NOT NULL) AS hit FROM packages)")
def source_coverage(spark, folder):
    return integrity.coverage(table(spark, folder, "packages"), table(spark, folder, "documents"), "package_id")


@add("index_difference", "WITH w AS (SELECT DISTINCT source_id, chunk_id FROM chunks WHERE ingested_at < TIMESTAMP '2025-01-01'), n AS (SELECT DISTINCT source_id, chunk_id FROM chunks WHERE coalesce(text, '') <> '') SELECT source_id, chunk_id, 'missing' AS side FROM (SELECT * FROM n EXCEPT SELECT * FROM w) UNION ALL SELECT source_id, chunk_id, 'extra' FROM (SELECT * FROM w EXCEPT SELECT * FROM n)")
def index_difference(spark, folder):
    c = table(spark, folder, "chunks")
    return integrity.set_difference(c.where("coalesce(text, '') <> ''"), c.where("ingested_at < timestamp'2025-01-01'"), ["source_id", "chunk_id"])


@add("scope_intersection", "SELECT package_id FROM documents INTERSECT SELECT source_id FROM eval_cases")
def scope_intersection(spark, folder):
    return table(spark, folder, "documents").select("package_id").intersect(cases(spark, folder).select(F.col("source_id").alias("package_id")))


@add(
    "case_problems",
    f"""WITH {ITEMS}, ev AS (SELECT DISTINCT id, source_id, item_id FROM (SELECT id, source_id, unnest(evidence_item_ids) AS item_id FROM eval_cases) WHERE item_id IS NOT NULL), wp AS (SELECT DISTINCT id, path FROM (SELECT id, unnest(wiki_page_paths) AS path FROM eval_cases) WHERE path IS NOT NULL)
SELECT 'error' AS severity, 'repeated_id' AS rule, id AS record FROM eval_cases GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'error', 'repeated_question', question FROM eval_cases WHERE question IS NOT NULL GROUP BY question HAVING count(*) > 1
UNION ALL SELECT 'error', 'no_evidence', id FROM eval_cases WHERE coalesce(len(evidence_item_ids), 0) = 0
UNION ALL SELECT 'error', 'no_answer', id FROM eval_cases WHERE expected_answerable AND coalesce(expected_answer, '') = ''
UNION ALL SELECT 'error', 'unknown_source', id FROM eval_cases WHERE source_id NOT IN (SELECT package_id FROM packages)
UNION ALL SELECT DISTINCT 'error', 'unknown_item', id FROM ev ANTI JOIN items USING (source_id, item_id)
UNION ALL SELECT DISTINCT 'warning', 'unknown_page', id FROM wp ANTI JOIN documents USING (path)""",
)
def case_problems(spark, folder):
    return integrity.case_problems(cases(spark, folder), table(spark, folder, "packages"), table(spark, folder, "package_items"), table(spark, folder, "documents"))


# ---- rollups ----------------------------------------------------------------------------------------------------------
@add(
    "source_summary",
    f"""WITH {ITEMS}, {CHUNKS}, a AS (SELECT source_id, count(*) AS items, string_agg(DISTINCT item_type, ',' ORDER BY item_type) AS kinds, count(*) FILTER (item_type IN ('image','figure','chart','table','equation') OR len(asset_ids) > 0) AS rich_items FROM items GROUP BY 1),
b AS (SELECT source_id, count(*) AS chunks FROM cs GROUP BY 1), c AS (SELECT package_id AS source_id, count(*) AS pages FROM documents GROUP BY 1)
SELECT p.package_id AS source_id, p.title, coalesce(kinds, '') AS kinds, coalesce(items, 0) AS items, coalesce(rich_items, 0) AS rich_items, coalesce(chunks, 0) AS chunks, coalesce(pages, 0) AS pages FROM packages p LEFT JOIN a ON a.source_id = p.package_id LEFT JOIN b ON b.source_id = p.package_id LEFT JOIN c ON c.source_id = p.package_id""",
)
def source_summary(spark, folder):
    return rollups.source_summary(table(spark, folder, "packages"), items_of(spark, folder, ["item_type", "asset_ids"]), chunks_of(spark, folder, ["derived"]), table(spark, folder, "documents"))


@add("outline", f"WITH {ITEMS} SELECT source_id, coalesce(nullif(breadcrumb, ''), '未分节') AS section, min(sequence) AS first_sequence, count(*) AS items, string_agg(DISTINCT item_type, ', ' ORDER BY item_type) AS kinds, min(page_start) AS first_page, max(page_start) AS last_page, count(DISTINCT page_start) AS pages FROM items GROUP BY 1, 2")
def outline(spark, folder):
    return rollups.outline(items_of(spark, folder, ["breadcrumb", "sequence", "item_type", "page_start"]))


@add("usage_rollup", "SELECT event_type, key, sum(floor(n))::BIGINT AS total, count(*) AS records FROM (SELECT event_type, unnest(json_keys(props)) AS key, try_cast(json_extract_string(props, unnest(json_keys(props))) AS DOUBLE) AS n FROM events) WHERE n IS NOT NULL GROUP BY 1, 2")
def usage_rollup(spark, folder):
    return rollups.usage(table(spark, folder, "events"), "event_type", "props")


@add("latency_by_type", "SELECT event_type, count(value) AS records, round(avg(value), 3) AS mean, round(quantile_disc(value, 0.95), 3) AS p95 FROM events GROUP BY 1")
def latency_by_type(spark, folder):
    return rollups.nearest_rank(table(spark, folder, "events"), ["event_type"], "value")


@add("case_histogram", "SELECT field, coalesce(nullif(value, ''), 'unknown') AS value, count(*) AS records FROM (SELECT unnest(['modality','difficulty','expected_mode','answerable']) AS field, unnest([modality, difficulty, expected_mode, expected_answerable::VARCHAR]) AS value FROM eval_cases) GROUP BY 1, 2")
def case_histogram(spark, folder):
    return rollups.histogram(cases(spark, folder), {"modality": F.col("modality"), "difficulty": F.col("difficulty"), "expected_mode": F.col("expected_mode"), "answerable": F.col("expected_answerable")})


@add("plan_histogram", "SELECT field, coalesce(nullif(value, ''), 'unknown') AS value, count(*) AS records FROM (SELECT unnest(['resource_type','ocr_policy','run_ocr','run_caption']) AS field, unnest([processing_policy.resource_type, processing_policy.ocr_policy, processing_policy.run_ocr::VARCHAR, processing_policy.run_caption::VARCHAR]) AS value FROM visual_cache) GROUP BY 1, 2")
def plan_histogram(spark, folder):
    p = "processing_policy"
    return rollups.histogram(table(spark, folder, "visual_cache"), {c: F.col(f"{p}.{c}") for c in ("resource_type", "ocr_policy", "run_ocr", "run_caption")})


# ---- tables, identifiers and pages ------------------------------------------------------------------------------------
_CLEAN = lambda x: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@add("html_rows", f"WITH {ITEMS} SELECT source_id, item_id, list_filter(list_transform(regexp_extract_all(coalesce(table_html, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: {_CLEAN('c')})), lambda r: len(r) > 0) AS rows FROM items WHERE coalesce(table_html, '') <> ''")
def html_rows(spark, folder):
    return items_of(spark, folder, ["table_html"]).where("coalesce(table_html, '') <> ''").select("source_id", "item_id", tx.html_rows(F.col("table_html")).alias("rows"))


@add("html_text", f"WITH {ITEMS} SELECT source_id, item_id, {_CLEAN('table_html')} AS text FROM items WHERE coalesce(table_html, '') <> ''")
def html_text(spark, folder):
    return items_of(spark, folder, ["table_html"]).where("coalesce(table_html, '') <> ''").select("source_id", "item_id", tx.clean_html(F.col("table_html")).alias("text"))


_CELL = "replace(trim(regexp_replace(coalesce(c, ''), '\\s+', ' ', 'g')), '|', '\\|')"


@add(
    "table_markdown",
    f"""WITH {ITEMS}, t AS (SELECT source_id, item_id, table_rows, list_max(list_transform(table_rows, lambda r: len(r))) AS width FROM items WHERE len(table_rows) > 0),
l AS (SELECT source_id, item_id, width, list_transform(table_rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: {_CELL}), list_transform(range(0, width - len(r)), lambda i: '')), ' | ') || ' |') AS lines FROM t)
SELECT source_id, item_id, array_to_string(list_concat(lines[1:1], ['| ' || array_to_string(list_transform(range(0, width), lambda i: '---'), ' | ') || ' |'], lines[2:]), chr(10)) AS markdown FROM l WHERE width > 0""",
)
def table_markdown(spark, folder):
    rows = items_of(spark, folder, ["table_rows"]).where("size(table_rows) > 0").select("source_id", "item_id", tx.table_markdown(F.col("table_rows")).alias("markdown"))
    return rows.where("markdown <> ''")


@add("slugs", "SELECT package_id, regexp_replace(regexp_replace(trim(coalesce(title, '')), '[^\\p{L}\\p{M}\\p{N}_.-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') AS slug FROM packages")
def slugs(spark, folder):
    return table(spark, folder, "packages").select("package_id", tx.slug(F.col("title")).alias("slug"))


_PIPE_TABLE = f"""CASE WHEN coalesce(list_max(list_transform(table_rows, lambda r: len(r))), 0) > 0 THEN array_to_string(list_concat(pipe[1:1], ['| ' || array_to_string(list_transform(range(0, width), lambda i: '---'), ' | ') || ' |'], pipe[2:]), chr(10)) ELSE '' END"""


@add(
    "rendered_pages",
    f"""WITH {ITEMS}, w AS (SELECT *, list_max(list_transform(table_rows, lambda r: len(r))) AS width FROM items), l AS (SELECT *, list_transform(table_rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: {_CELL}), list_transform(range(0, width - len(r)), lambda i: '')), ' | ') || ' |') AS pipe FROM w),
b AS (SELECT source_id, page_start AS page, floor(coalesce(sequence, 0) / 500)::INT AS part, coalesce(sequence, 0) AS sequence, item_id, array_to_string(list_filter([trim({_TEXT}), {_PIPE_TABLE}, CASE WHEN coalesce(latex, '') <> '' THEN '$$' || latex || '$$' ELSE '' END, '`' || source_id || '@' || coalesce(source_version, '') || '#' || item_id || '`'], lambda x: coalesce(x, '') <> ''), chr(10) || chr(10)) AS block FROM l)
SELECT source_id, page, part, count(*)::INT AS items, string_agg(block, chr(10) || chr(10) ORDER BY sequence, item_id) AS markdown FROM b GROUP BY 1, 2, 3""",
)
def rendered_pages(spark, folder):
    keep = ["source_version", "sequence", "page_start", "raw_text", "caption", "search_text", "table_rows", "latex"]
    return pages.rendered_pages(items_of(spark, folder, keep))


@add("page_summaries", "SELECT doc_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(regexp_replace(x, '^#+', ''), '\\s+', ' ', 'g'))), lambda x: x <> '')[1], '') AS summary FROM documents")
def page_summaries(spark, folder):
    return table(spark, folder, "documents").select("doc_id", pages.page_summary(F.col("text")).alias("summary"))


# ---- graph ------------------------------------------------------------------------------------------------------------
def linked(spark, folder, strict=True):
    nodes = pages_of(spark, folder)
    names = graph.aliases(nodes)
    return nodes, names, graph.links(nodes, names, strict)


@add("wiki_links", f"WITH {_LINKS} SELECT source, link, target FROM found")
def wiki_links(spark, folder):
    return linked(spark, folder)[2]


@add("link_authority", f"WITH {_LINKS}, i AS (SELECT target AS path, count(*) AS inbound FROM edges GROUP BY 1) SELECT path, coalesce(inbound, 0) AS inbound, round(0.15 * ln(1 + coalesce(inbound, 0)), 6) AS authority FROM nodes LEFT JOIN i USING (path)")
def link_authority(spark, folder):
    nodes, _, found = linked(spark, folder)
    return graph.authority(nodes, found)


@add("wanted_pages", f"WITH {_LINKS} SELECT link, count(DISTINCT source) AS pages FROM found WHERE target IS NULL GROUP BY 1")
def wanted_pages(spark, folder):
    return graph.wanted(linked(spark, folder)[2])


@add("ambiguous_aliases", f"WITH {PAGES}, {_ALIASES} SELECT alias, path FROM names WHERE ambiguous")
def ambiguous_aliases(spark, folder):
    return graph.aliases(pages_of(spark, folder)).where("ambiguous").select("alias", "path")


@add(
    "graph_health",
    f"""WITH {_LINKS} SELECT 'nodes' AS measure, count(*) AS value FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'orphans', count(*) FROM nodes WHERE path NOT IN (SELECT target FROM edges)
UNION ALL SELECT 'wanted', count(DISTINCT link) FROM found WHERE target IS NULL UNION ALL SELECT 'ambiguous_names', count(*) FROM names WHERE ambiguous UNION ALL SELECT 'duplicate_titles', count(*) FROM (SELECT lower(title) AS t FROM nodes WHERE title IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""",
)
def graph_health(spark, folder):
    return graph.health(*linked(spark, folder))


@add("provenance_edges", f"WITH {PAGES} SELECT path, n.package_id AS source_id, p.package_id IS NOT NULL AS known FROM (SELECT DISTINCT path, package_id FROM documents WHERE path IS NOT NULL AND path <> '' AND package_id IS NOT NULL) n LEFT JOIN packages p ON p.package_id = n.package_id")
def provenance_edges(spark, folder):
    d = table(spark, folder, "documents").where("path is not null and path <> '' and package_id is not null").select("path", F.col("package_id").alias("source_id")).distinct()
    known = table(spark, folder, "packages").select(F.col("package_id").alias("source_id"), F.lit(True).alias("known"))
    return d.join(known, "source_id", "left").select("path", "source_id", F.coalesce("known", F.lit(False)).alias("known"))


# ---- incremental maintenance ------------------------------------------------------------------------------------------
CUT = "2025-01-01"
_RECORDS = f"{CHUNKS}, now AS (SELECT c.source_id, c.chunk_id, c.ingested_at, c.derived, sha256(array_to_string(list_filter([coalesce(p.title, ''), coalesce(c.breadcrumb, ''), coalesce(c.text, '')], lambda s: s <> ''), chr(10))) AS h, p.source_version AS v, p.parser_version AS pv FROM cs c LEFT JOIN packages p ON p.package_id = c.source_id), old AS (SELECT source_id, chunk_id, h, CASE WHEN pv IS NULL THEN 'older' ELSE v END AS v FROM now WHERE ingested_at < TIMESTAMP '{CUT}')"
_PLAN = _RECORDS + ", plan AS (SELECT source_id, chunk_id, CASE WHEN n.h IS NULL THEN 'drop' WHEN o.h = n.h AND o.v IS NOT DISTINCT FROM n.v THEN 'reuse' ELSE 'embed' END AS action FROM old o FULL JOIN (SELECT source_id, chunk_id, h, v FROM now) n USING (source_id, chunk_id))"


def index_states(spark, folder):
    """The index as of CUT (packages without a parser version then had an older version) and the current records."""
    chunks = chunks_of(spark, folder, ["breadcrumb", "text"])
    packages = table(spark, folder, "packages")
    now = index.index_records(chunks, packages)
    before = index.index_records(chunks.where(f"ingested_at < timestamp'{CUT}'"), packages.withColumn("source_version", F.when(F.col("parser_version").isNull(), "older").otherwise(F.col("source_version"))))
    return before, now


@add("index_plan", f"WITH {_PLAN} SELECT * FROM plan")
def index_plan(spark, folder):
    return index.plan_update(*index_states(spark, folder))


@add("index_status", f"WITH {_PLAN}, t AS (SELECT count(*) FILTER (action = 'reuse') AS reusable, count(*) FILTER (action = 'embed') AS to_embed, count(*) FILTER (action = 'drop') AS to_drop FROM plan) SELECT reusable + to_drop AS indexed, reusable + to_embed AS expected, reusable, to_embed, to_drop, to_embed = 0 AND to_drop = 0 AS fresh FROM t")
def index_status(spark, folder):
    return index.index_status(*index_states(spark, folder))


@add("stale_sources", f"WITH {_PLAN} SELECT source_id, count(*) FILTER (action <> 'embed') AS indexed, count(*) FILTER (action <> 'drop') AS expected, count(*) FILTER (action <> 'reuse') AS changed FROM plan GROUP BY 1 HAVING changed > 0")
def stale_sources(spark, folder):
    return index.stale_sources(*index_states(spark, folder))


@add("updated_index", f"WITH {_RECORDS} SELECT n.source_id, n.chunk_id, n.h AS content_hash, n.v AS source_version, o.h IS NOT NULL AS reused FROM now n LEFT JOIN old o ON o.source_id = n.source_id AND o.chunk_id = n.chunk_id AND o.h = n.h AND o.v = n.v")
def updated_index(spark, folder):
    before, now = index_states(spark, folder)
    return index.update_index(before.withColumn("vector", vx.hash_embedding(F.col("text"))), now).select("source_id", "chunk_id", "content_hash", "source_version", "reused")


_SHA_TREE = lambda rows, keys: f"h AS ({rows}), b AS (SELECT {keys}, substr(hash, 1, 4) AS bucket, count(*) AS n, sha256(string_agg(hash, '' ORDER BY hash)) AS digest FROM h GROUP BY ALL) SELECT {keys}, sum(n)::BIGINT AS records, sha256(string_agg(digest, '' ORDER BY bucket)) AS fingerprint FROM b GROUP BY ALL"
_JSON_TEXT = lambda x: f"coalesce(to_json({x})::VARCHAR, 'null')"


@add(
    "chunk_fingerprints",
    f"""WITH {CHUNKS}, {ASSETS}, """
    + _SHA_TREE(
        f"""SELECT source_id, sha256('{{"asset_ids":' || {_JSON_TEXT('asset_ids')} || ',"chunk_id":' || {_JSON_TEXT('chunk_id')} || ',"text":' || {_JSON_TEXT('text')} || '}}') AS hash FROM cs UNION ALL SELECT source_id, sha256('{{"asset_id":' || {_JSON_TEXT('asset_id')} || ',"sha256":' || {_JSON_TEXT('sha256')} || ',"vault_path":' || {_JSON_TEXT('vault_path')} || '}}') FROM ast""",
        "source_id",
    ),
)
def chunk_fingerprints(spark, folder):
    return index.chunk_fingerprints(chunks_of(spark, folder, ["asset_ids", "text"]), assets_of(spark, folder, ["sha256", "vault_path"]))


@add("page_fingerprint", f"WITH {PAGES}, " + _SHA_TREE("SELECT 1 AS every, sha256(path || chr(10) || coalesce(title, '') || chr(10) || sha256(coalesce(text, ''))) AS hash FROM nodes", "every").replace("SELECT every, sum", "SELECT sum").replace("FROM b GROUP BY ALL", "FROM b GROUP BY every"))
def page_fingerprint(spark, folder):
    return index.page_fingerprint(pages_of(spark, folder))


_PAGE_STATES = "old AS (SELECT path, title, [package_id] AS ids, sha256(coalesce(text, '')) AS h FROM nodes WHERE updated_at < TIMESTAMP '2025-01-01' AND package_id IS NOT NULL), fresh AS (SELECT path, title, [package_id] AS ids, CASE WHEN updated_at < TIMESTAMP '2024-07-01' THEN sha256(coalesce(text, '')) ELSE sha256(coalesce(text, '') || coalesce(title, '')) END AS h FROM nodes WHERE updated_at >= TIMESTAMP '2024-01-01' AND package_id IS NOT NULL)"


def page_states(spark, folder):
    """Pages known before 2025, and those delivered since 2024 (from mid 2024 on with changed content)."""
    d = table(spark, folder, "documents").where("path is not null and path <> ''")
    first = F.min(F.struct("doc_id", "title", "package_id", "text", "updated_at")).alias("f")
    nodes = d.groupBy("path").agg(first).select("path", "f.*").where("package_id is not null").withColumn("source_ids", F.array("package_id"))
    same, other = F.sha2(tx.empty(F.col("text")), 256), F.sha2(F.concat(tx.empty(F.col("text")), tx.empty(F.col("title"))), 256)
    old = nodes.where("updated_at < timestamp'2025-01-01'").select("path", "title", "source_ids", same.alias("content_hash"), F.lit(1).alias("revision"))
    fresh = nodes.where("updated_at >= timestamp'2024-01-01'").select("path", "title", "source_ids", F.when(F.col("updated_at") < "2024-07-01", same).otherwise(other).alias("content_hash"))
    return old, fresh


@add("upserted_pages", f"WITH {PAGES}, {_PAGE_STATES} SELECT path, coalesce(f.title, o.title) AS title, list_distinct(list_concat(coalesce(o.ids, []), coalesce(f.ids, []))) AS source_ids, (CASE WHEN o.path IS NULL THEN 0 ELSE 1 END + CASE WHEN f.h IS NOT NULL AND f.h IS DISTINCT FROM o.h THEN 1 ELSE 0 END)::INT AS revision, f.h IS NOT NULL AND f.h IS DISTINCT FROM o.h AS changed FROM old o FULL JOIN fresh f USING (path)")
def upserted_pages(spark, folder):
    return pages.upsert_pages(*page_states(spark, folder))


_CITED = f"{PAGES}, cited AS (SELECT n.path, list_distinct(list_concat(CASE WHEN n.package_id IS NULL THEN [] ELSE [n.package_id] END, coalesce(list(m.package_id ORDER BY m.package_id) FILTER (m.package_id IS NOT NULL), []))) AS ids FROM nodes n LEFT JOIN (SELECT DISTINCT title, package_id FROM documents) m ON m.title = n.title GROUP BY n.path, n.package_id)"


@add("curated_pages", f"WITH {_CITED}, keep AS (SELECT package_id FROM packages WHERE parser_version IS NOT NULL), e AS (SELECT path, unnest(ids) AS p FROM cited), j AS (SELECT path, count(*) AS n, count(*) FILTER (p IN (SELECT package_id FROM keep)) AS k FROM e GROUP BY 1) SELECT path, CASE WHEN coalesce(n, 0) = coalesce(k, 0) THEN 'keep' WHEN k = 0 THEN 'drop' ELSE 'mixed' END AS action FROM cited LEFT JOIN j USING (path)")
def curated_pages(spark, folder):
    """What becomes of pages, each with all packages that have a page of its title, if packages with a parser version stay."""
    d = table(spark, folder, "documents")
    nodes = d.where("path is not null and path <> ''").groupBy("path").agg(F.min(F.struct("doc_id", "title", "package_id")).alias("f")).select("path", "f.title", "f.package_id")
    keep = table(spark, folder, "packages").where("parser_version is not null").select(F.col("package_id").alias("source_id"))
    return pages.curated_by_title(nodes, d, keep)


# ---- evaluation -------------------------------------------------------------------------------------------------------
_RANKS = f"{CHUNKS}, " + sql_bm25(_QUESTIONS, _CHUNK_DOCS, more=_BOOSTS) + """, hits AS (SELECT r.query_id AS id, rank, c.source_id, c.item_ids FROM ranked r JOIN cs c ON c.source_id || '#' || c.chunk_id = r.doc_key),
ranks AS (SELECT e.id, e.modality, e.difficulty, min(h.rank) AS first_rank FROM eval_cases e LEFT JOIN hits h ON h.id = e.id AND h.source_id = e.source_id AND list_has_any(list_filter(e.evidence_item_ids, lambda x: x IS NOT NULL), list_filter(h.item_ids, lambda x: x IS NOT NULL)) GROUP BY 1, 2, 3)"""
_METRICS = "count(*) AS cases, round(avg(CASE WHEN first_rank IS NULL THEN 0 ELSE 1 END), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 4) AS mrr, round(avg(CASE WHEN first_rank = 1 THEN 1.0 ELSE 0.0 END), 4) AS top1, round(avg(coalesce(1.0::DOUBLE / log2(first_rank + 1.0), 0)), 4) AS ndcg"


def case_ranks(spark, folder):
    hits = bm25_chunk_topk(spark, folder)
    known = chunks_of(spark, folder, ["item_ids"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), "source_id", "item_ids")
    ranks = evaluation.first_relevant(cases(spark, folder), hits.join(known, "doc_key"))
    return ranks.join(cases(spark, folder).select("id", "modality", "difficulty"), "id")


@add("relevant_ranks", f"WITH {_RANKS} SELECT id, modality, difficulty, first_rank FROM ranks")
def relevant_ranks(spark, folder):
    return case_ranks(spark, folder)


@add("retrieval_metrics", f"WITH {_RANKS} SELECT {_METRICS} FROM ranks")
def retrieval_metrics(spark, folder):
    return evaluation.retrieval_metrics(case_ranks(spark, folder))


@add("metrics_by_group", f"WITH {_RANKS} SELECT coalesce(nullif(modality, ''), 'unknown') AS modality, coalesce(nullif(difficulty, ''), 'unknown') AS difficulty, {_METRICS} FROM ranks GROUP BY 1, 2")
def metrics_by_group(spark, folder):
    group = [F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown")).alias(c) for c in ("modality", "difficulty")]
    return evaluation.retrieval_metrics(case_ranks(spark, folder), group)


_ANSWERS = _RANKS + ", best AS (SELECT r.query_id AS id, c.text AS answer FROM ranked r JOIN cs c ON c.source_id || '#' || c.chunk_id = r.doc_key WHERE rank = 1)"


@add(
    "concept_coverage",
    f"WITH {_ANSWERS} SELECT e.id, coalesce(list_bool_and(list_transform(e.required_keyword_groups, lambda g: coalesce(list_bool_or(list_transform(g, lambda a: contains(lower(coalesce(b.answer, '')), lower(a)))), false))), true) AS covered, round(len(list_filter(e.required_keywords, lambda w: w IS NOT NULL AND w <> '' AND contains(lower(coalesce(b.answer, '')), lower(w)))) / nullif(len(list_filter(e.required_keywords, lambda w: w IS NOT NULL AND w <> '')), 0), 4) AS keywords FROM eval_cases e LEFT JOIN best b USING (id)",
)
def concept_coverage(spark, folder):
    best = bm25_chunk_topk(spark, folder).where("rank = 1")
    texts = chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), F.col("text").alias("answer"))
    return evaluation.concept_coverage(cases(spark, folder), best.join(texts, "doc_key").select(F.col("query_id").alias("id"), "answer"))
