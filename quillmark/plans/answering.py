"""Queries from evidence to answers: citations, titles, navigation, answer quality, staged builds and page indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions import vectors as vx
from quillmark.operators import bm25, citing, context, evaluation, stages
from quillmark.plans import ingest as ing
from quillmark.plans import retrieval as rt
from quillmark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


def sub(name: str) -> str:
    """The SQL of another query, as a table to select from."""
    return f"({(rt.ORACLE | ing.ORACLE | ORACLE)[name]})"


# ---- citations and the evidence behind them ---------------------------------------------------------------------------
_HIT_ITEMS = f"(SELECT r.query_id, r.rank, r.doc_key, r.score, c.source_id, c.item_ids FROM {sub('bm25_chunk_topk')} r JOIN (WITH {rt.CHUNKS} SELECT * FROM cs) c ON c.source_id || '#' || c.chunk_id = r.doc_key)"


def hits_with_items(spark, folder):
    known = rt.chunks_of(spark, folder, ["item_ids"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), "source_id", "item_ids")
    return rt.bm25_chunk_topk(spark, folder).join(known, "doc_key")


@add(
    "citation_hits",
    f"""WITH s AS (SELECT * FROM {sub('evidence_selection')}), h AS (SELECT query_id, source_id, rank, doc_key, score, unnest(item_ids) AS item_id FROM {_HIT_ITEMS}),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, source_id, item_id ORDER BY rank, doc_key) = 1)
SELECT s.query_id, place, s.source_id, s.item_id, rank AS hit_rank, coalesce(doc_key, 'adjacent-context-' || s.item_id) AS hit_key, coalesce(score, 0.0) AS score, CASE WHEN doc_key IS NULL THEN 'adjacent_context' ELSE 'bm25' END AS channel FROM s LEFT JOIN f ON f.query_id = s.query_id AND f.source_id = s.source_id AND f.item_id = s.item_id""",
)
def citation_hits(spark, folder):
    return citing.cited_hits(rt.evidence_selection(spark, folder).drop("origin"), hits_with_items(spark, folder))


_PAGE_EVIDENCE = "pe AS (SELECT DISTINCT path, source_id, item_id FROM (SELECT source_id, path, unnest(evidence_item_ids) AS item_id FROM (SELECT source_id, evidence_item_ids, unnest(wiki_page_paths) AS path FROM eval_cases)) WHERE path <> '' AND item_id <> '' AND source_id IS NOT NULL), nodes AS (SELECT path, arg_min(struct_pack(title := title, kind := kind, package_id := package_id), doc_id) AS f FROM documents WHERE path <> '' GROUP BY 1), pg AS (SELECT path, f.title AS title, f.kind AS kind, f.package_id AS package_id FROM nodes), sp AS (SELECT pe.source_id, pe.item_id, pg.path, title, kind FROM pe JOIN pg ON pg.path = pe.path)"


def pages_of(spark, folder):
    d = table(spark, folder, "documents").where("path is not null and path <> ''")
    return d.groupBy("path").agg(F.min_by(F.struct("title", "kind", "package_id"), "doc_id").alias("f")).select("path", "f.*")


@add("supporting_pages", f"WITH {_PAGE_EVIDENCE} SELECT * FROM sp")
def supporting_pages(spark, folder):
    return citing.supporting_pages(citing.page_evidence(rt.cases(spark, folder)), pages_of(spark, folder))


@add(
    "evidence_titles",
    f"""WITH {_PAGE_EVIDENCE}, b AS (SELECT source_id, item_id, title, path FROM sp WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY source_id, item_id ORDER BY CASE kind WHEN 'entity' THEN 0 WHEN 'analysis' THEN 1 WHEN 'concept' THEN 2 ELSE 3 END, title, path) = 1)
SELECT e.source_id, e.item_id, coalesce(nullif(b.title, ''), nullif(p.title, ''), e.source_id) AS title, b.path FROM (SELECT DISTINCT source_id, item_id FROM pe) e LEFT JOIN b USING (source_id, item_id) LEFT JOIN packages p ON p.package_id = e.source_id""",
)
def evidence_titles(spark, folder):
    evidence = citing.page_evidence(rt.cases(spark, folder))
    return citing.evidence_titles(evidence, citing.supporting_pages(evidence, pages_of(spark, folder)), table(spark, folder, "packages"))


@add("preserved_evidence", f"WITH {_PAGE_EVIDENCE} SELECT path, source_id, item_id FROM pe SEMI JOIN package_items i USING (source_id, item_id)")
def preserved_evidence(spark, folder):
    """The evidence of pages that its package still has."""
    own = table(spark, folder, "package_items").select("source_id", "item_id")
    return citing.page_evidence(rt.cases(spark, folder)).join(own, ["source_id", "item_id"], "left_semi").select("path", "source_id", "item_id")


@add("action_pages", "WITH n AS (SELECT path, arg_min(struct_pack(title := title, kind := kind, t := updated_at), doc_id) AS f FROM documents WHERE path <> '' GROUP BY 1) SELECT path, f.title AS title, f.kind AS kind FROM n WHERE f.t < TIMESTAMP '2025-01-01' AND EXISTS (SELECT 1 FROM documents d WHERE d.updated_at >= TIMESTAMP '2025-01-01' AND lower(trim(d.title)) = lower(trim(n.f.title)) AND d.kind = n.f.kind)")
def action_pages(spark, folder):
    """Pages from before 2025 that a delivery since then names by title and kind."""
    d = table(spark, folder, "documents")
    first = d.where("path is not null and path <> ''").groupBy("path").agg(F.min_by(F.struct("title", "kind", "updated_at"), "doc_id").alias("f")).select("path", "f.*")
    return citing.matching_pages(first.where("updated_at < timestamp'2025-01-01'"), d.where("updated_at >= timestamp'2025-01-01'"))


_ENTRY_LABEL = "CASE WHEN length(name) > 60 THEN substr(name, 1, 57) || '…' ELSE name END"


@add(
    "evidence_entries",
    f"""WITH s AS (SELECT * FROM {sub('evidence_selection')}), l AS (SELECT source_id, item_id, page_number, label FROM {sub('item_locators')}), i AS (SELECT *, trim(regexp_extract(coalesce(caption, ''), '^([^:：]*)[:：]', 1)) AS head FROM (WITH {rt.ITEMS} SELECT * FROM items)),
n AS (SELECT s.query_id, s.place, s.source_id, s.item_id, i.item_type, l.page_number, l.label AS location, coalesce(nullif(p.title, ''), s.source_id) AS title, coalesce(CASE WHEN length(head) BETWEEN 1 AND 60 THEN head END, nullif(trim(list_last(string_split(coalesce(breadcrumb, ''), ' > '))), ''), nullif(item_type, ''), '') AS name FROM s JOIN i USING (source_id, item_id) JOIN l USING (source_id, item_id) LEFT JOIN packages p ON p.package_id = s.source_id)
SELECT query_id, place, source_id, item_id, item_type, page_number, location, title, {_ENTRY_LABEL} AS label FROM n""",
)
def evidence_entries(spark, folder):
    """The selected evidence as a reader sees it: type, page, place on it, source title and a short label."""
    items = rt.items_of(spark, folder)
    places = context.locators(items).select("source_id", "item_id", "page_number", F.col("label").alias("location"))
    named = items.select("source_id", "item_id", "item_type", citing.evidence_label(F.col("item_type"), F.col("caption"), F.col("breadcrumb")).alias("label"))
    titles = table(spark, folder, "packages").select(F.col("package_id").alias("source_id"), "title")
    joined = rt.evidence_selection(spark, folder).drop("origin").join(named, ["source_id", "item_id"]).join(places, ["source_id", "item_id"]).join(titles, "source_id", "left")
    return joined.select("query_id", "place", "source_id", "item_id", "item_type", "page_number", "location", tx.filled(F.col("title"), F.col("source_id")).alias("title"), "label")


_REVERSED = f"(SELECT query_id, string_agg('- ' || doc_key || ' says [' || doc_key || ']', chr(10) ORDER BY doc_key) FILTER (rank <> 2) AS answer, list(doc_key ORDER BY rank) AS ids FROM {sub('bm25_chunk_topk')} WHERE rank <= 5 GROUP BY 1)"


@add("citation_order", f"WITH a AS {_REVERSED}, e AS (SELECT query_id, answer, unnest(ids) AS doc_key, generate_subscripts(ids, 1) AS given FROM a), p AS (SELECT *, instr(coalesce(answer, ''), '[' || doc_key || ']') AS spot FROM e) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY spot = 0, spot, given)::INT AS place, doc_key FROM p")
def citation_order(spark, folder):
    """Ids in the order of an answer that cites its hits by key and leaves the second out."""
    hits = rt.bm25_chunk_topk(spark, folder).where("rank <= 5")
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_key"))).alias("h"))  # five rows at most
    cited = F.array_sort(F.transform(F.filter("h", lambda x: x.rank != 2), lambda x: x.doc_key))
    answer = F.array_join(F.transform(cited, lambda k: F.concat(F.lit("- "), k, F.lit(" says ["), k, F.lit("]"))), "\n")
    return citing.citation_order(lists.select("query_id", answer.alias("answer"), F.transform("h", lambda x: x.doc_key).alias("citations")))


@add("hit_pages", f"WITH p AS (SELECT package_id AS source_id, count(*) AS pages, min(path) AS first_page FROM (WITH {_PAGE_EVIDENCE} SELECT * FROM pg) WHERE package_id IS NOT NULL GROUP BY 1) SELECT query_id, rank, doc_key, split_part(doc_key, '#', 1) AS source_id, coalesce(pages, 0) AS pages, first_page FROM {sub('bm25_chunk_topk')} h LEFT JOIN p ON p.source_id = split_part(doc_key, '#', 1)")
def hit_pages(spark, folder):
    hits = rt.bm25_chunk_topk(spark, folder).withColumn("source_id", F.substring_index("doc_key", "#", 1))
    return citing.hit_pages(hits, pages_of(spark, folder))


@add("first_hit_with_asset", f"WITH a AS (SELECT source_id || '#' || chunk_id AS doc_key FROM {sub('hit_assets')}), h AS (SELECT query_id, rank, h.doc_key, a.doc_key IS NOT NULL AS with_asset FROM {sub('bm25_chunk_topk')} h LEFT JOIN a ON a.doc_key = h.doc_key) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY NOT with_asset, rank) = 1")
def first_hit_with_asset(spark, folder):
    return citing.first_with_asset(rt.bm25_chunk_topk(spark, folder), rt.hit_assets(spark, folder))


@add(
    "evidence_map",
    f"""WITH l AS (SELECT source_id, item_id, label FROM {sub('item_locators')}), i AS (WITH {rt.ITEMS} SELECT * FROM items)
SELECT source_id, coalesce(nullif(breadcrumb, ''), '未分节') AS section, floor(coalesce(sequence, 0) / 500)::INT AS part, count(*)::INT AS items, string_agg('- ' || coalesce(label, '?') || ' `' || item_id || '`', chr(10) ORDER BY coalesce(sequence, 0), item_id) AS markdown FROM i JOIN l USING (source_id, item_id) GROUP BY 1, 2, 3""",
)
def evidence_map(spark, folder):
    """Per source and section, in parts of a range of the sequence: the items in order with their places, as Markdown."""
    items = rt.items_of(spark, folder)
    places = context.locators(items).select("source_id", "item_id", "label")
    line = F.concat(F.lit("- "), F.coalesce("label", F.lit("?")), F.lit(" `"), F.col("item_id"), F.lit("`"))
    row = F.struct(F.coalesce("sequence", F.lit(0)).alias("sequence"), "item_id", line.alias("line"))
    each = items.join(places, ["source_id", "item_id"]).select("source_id", tx.filled(F.col("breadcrumb"), F.lit("未分节")).alias("section"), context.stretch(F.col("sequence")).cast("int").alias("part"), row.alias("row"))
    grouped = each.groupBy("source_id", "section", "part").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return grouped.select("source_id", "section", "part", F.size("rows").alias("items"), F.array_join(F.transform("rows", lambda r: r.line), "\n").alias("markdown"))


# ---- navigation -------------------------------------------------------------------------------------------------------
_NAV = f"""pr AS (SELECT query_id, rank, path, package_id AS source_id FROM {sub('bm25_page_topk')} LEFT JOIN (WITH {_PAGE_EVIDENCE} SELECT * FROM pg) USING (path)), sr AS (SELECT * FROM {sub('rrf_sources')})"""


def navigated_pages(spark, folder):
    return rt.bm25_page_topk(spark, folder).join(pages_of(spark, folder).select("path", F.col("package_id").alias("source_id")), "path", "left")


@add(
    "navigation_ranks",
    f"""WITH {_NAV}, a AS (SELECT e.id, min(rank) AS source_rank FROM eval_cases e JOIN sr ON sr.query_id = e.id AND sr.source_id = e.source_id GROUP BY 1), b AS (SELECT e.id, min(rank) AS page_rank FROM eval_cases e JOIN pr ON pr.query_id = e.id AND pr.source_id = e.source_id GROUP BY 1),
c AS (SELECT e.id, min(rank) AS named_rank FROM (SELECT id, unnest(wiki_page_paths) AS path FROM eval_cases) e JOIN pr ON pr.query_id = e.id AND pr.path = e.path GROUP BY 1)
SELECT e.id, source_rank, page_rank, named_rank, coalesce(source_rank, page_rank) AS first_rank FROM eval_cases e LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id)""",
)
def navigation_ranks(spark, folder):
    return evaluation.navigation_ranks(rt.cases(spark, folder), navigated_pages(spark, folder), rt.rrf_sources(spark, folder))


_NUDGED = rt._CHUNK_RANK.replace("SELECT query_id, doc_key, coalesce(lex, 0) +", "SELECT query_id, doc_key, coalesce(nudge, 0) + coalesce(lex, 0) +").replace("LEFT JOIN lex USING (query_id, doc_key)", "LEFT JOIN lex USING (query_id, doc_key) LEFT JOIN nudges USING (query_id, source_id)")


@add("bm25_nudged", _NUDGED.replace("WITH ", f"WITH {_NAV}, nudges AS (SELECT query_id, source_id, round(0.001 / min(rank), 6) AS nudge FROM pr WHERE source_id IS NOT NULL GROUP BY 1, 2), ", 1) + " SELECT query_id, rank, doc_key, score FROM ranked")
def bm25_nudged(spark, folder):
    """Chunks ranked as ever, those of sources whose pages navigation found a little higher."""
    pages = navigated_pages(spark, folder).where("source_id is not null")
    nudges = pages.groupBy("query_id", "source_id").agg(F.round(0.001 / F.min("rank"), 6).alias("nudge"))  # at most ten per query
    return bm25.rank_documents(rt.questions(spark, folder), rt.chunk_documents(spark, folder), rt.TOP, nudges)


# ---- answers ----------------------------------------------------------------------------------------------------------
@add(
    "baseline_summary",
    ing._OVERLAP + r""", r AS (SELECT a = b AS exact, a <> '' AND contains(b, a) AS contained, coalesce(found, '') AS f, coalesce(expected_answer, '') AS e FROM o)
SELECT count(*) AS cases, count(*) FILTER (exact) AS exact, count(*) FILTER (contained) AS contained, count(*) FILTER (regexp_matches(f, '(?i)evidence\s*id')) AS with_evidence_id, count(*) FILTER (regexp_matches(f, '(?:〔|\[|【)\s*\d+\s*(?:〕|\]|】)')) AS with_marker,
round(avg(length(e)), 1) AS mean_expected, round(avg(length(f)), 1) AS mean_found, round(median(length(f) / greatest(length(e), 1)), 2) AS median_ratio, count(*) FILTER (length(f) / greatest(length(e), 1) > 3) AS over_3x FROM r""",
)
def baseline_summary(spark, folder):
    """The best hit's text as the answer to each case, compared with the expected one."""
    texts = rt.chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), F.col("text").alias("found"))
    best = rt.bm25_chunk_topk(spark, folder).where("rank = 1").join(texts, "doc_key").select(F.col("query_id").alias("id"), "found")
    expected = rt.cases(spark, folder).select("id", F.col("expected_answer").alias("expected"))
    return evaluation.baseline_summary(ing.answer_overlap(spark, folder).join(best, "id", "left").join(expected, "id"))


@add(
    "answer_metrics",
    f"""WITH c AS (SELECT * FROM {sub('concept_coverage')}), r AS (SELECT id, first_rank FROM {sub('relevant_ranks')}), x AS (SELECT coalesce(nullif(modality, ''), 'unknown') AS modality, coalesce(expected_answerable, false) AS a, covered, keywords, first_rank IS NOT NULL AS cited FROM eval_cases JOIN c USING (id) JOIN r USING (id))
SELECT modality, count(*) AS cases, round(avg(a::INT), 4) AS answerable, round(avg(covered::INT) FILTER (a), 4) AS coverage, round(avg(keywords), 4) AS keywords, round(avg(cited::INT), 4) AS citations FROM x GROUP BY 1""",
)
def answer_metrics(spark, folder):
    rows = rt.concept_coverage(spark, folder).join(rt.relevant_ranks(spark, folder).select("id", F.col("first_rank").isNotNull().alias("cited")), "id")
    asked = rt.cases(spark, folder).select("id", "modality", F.col("expected_answerable").alias("answerable"))
    return evaluation.answer_metrics(rows.join(asked, "id"), tx.filled(F.col("modality"), F.lit("unknown")).alias("modality"))


@add("candidate_summary", f"WITH h AS (SELECT split_part(doc_key, '#', 1) AS source_id, (SELECT any_value(coalesce(modalities[1], 'text')) FROM (WITH {rt.CHUNKS} SELECT * FROM cs) c WHERE c.source_id || '#' || c.chunk_id = doc_key) AS modality FROM {sub('bm25_chunk_topk')} WHERE rank = 1) SELECT 'source' AS field, source_id AS value, count(*) AS cases FROM h GROUP BY 2 UNION ALL SELECT 'modality', modality, count(*) FROM h GROUP BY 2")
def candidate_summary(spark, folder):
    """The sources and modalities that come first, with the number of cases."""
    kinds = rt.chunks_of(spark, folder, ["modalities"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), "source_id", F.coalesce(F.get("modalities", F.lit(0)), F.lit("text")).alias("modality"))
    best = rt.bm25_chunk_topk(spark, folder).where("rank = 1").join(kinds, "doc_key")
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in (("source", "source_id"), ("modality", "modality"))])
    return best.select(F.inline(both)).groupBy("field", "value").agg(F.count("*").alias("cases"))


@add("merged_actions", "WITH a AS (SELECT doc_id AS n, title, kind, CASE WHEN updated_at >= TIMESTAMP '2025-01-01' THEN 'update' ELSE 'create' END AS action, source AS reason, lower(trim(title)) AS k FROM documents WHERE title IS NOT NULL), r AS (SELECT k, kind, reason, min(n) AS n FROM a WHERE reason <> '' GROUP BY 1, 2, 3), l AS (SELECT k, kind, string_agg(reason, '；' ORDER BY n, reason) AS reasons FROM r GROUP BY 1, 2), h AS (SELECT k, kind, arg_min(title, n) AS title, max(action) AS action FROM a GROUP BY 1, 2) SELECT title, h.kind, action, coalesce(reasons, '') AS reasons FROM h LEFT JOIN l ON l.k = h.k AND l.kind IS NOT DISTINCT FROM h.kind")
def merged_actions(spark, folder):
    """Each page row as an action (an update since 2025) with its source as the reason, merged by title and kind."""
    d = table(spark, folder, "documents")
    action = F.when(F.col("updated_at") >= F.lit("2025-01-01").cast("timestamp"), "update").otherwise("create")
    return citing.merged_actions(d.select(F.col("doc_id").alias("n"), "title", "kind", action.alias("action"), F.col("source").alias("reason")))


# ---- counts and projections -------------------------------------------------------------------------------------------
@add("corpus_snapshot", f"SELECT (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM (SELECT DISTINCT source_id, item_id FROM package_items)) AS items, (SELECT count(*) FROM (SELECT DISTINCT source_id, chunk_id FROM chunks)) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT source_id, asset_id FROM assets)) AS assets, (SELECT count(DISTINCT path) FROM documents WHERE path <> '') AS pages, (SELECT count(*) FROM {sub('searchable_units')}) AS units")
def corpus_snapshot(spark, folder):
    """One row of counts; re-delivered rows count once."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    keys = {"items": ("package_items", "item_id"), "chunks": ("chunks", "chunk_id"), "assets": ("assets", "asset_id")}
    out = count(table(spark, folder, "packages"), "packages")
    for name, (source, key) in keys.items():
        out = out.crossJoin(count(table(spark, folder, source).select("source_id", key).distinct(), name))  # one row each
    out = out.crossJoin(count(table(spark, folder, "documents").where("path <> ''").select("path").distinct(), "pages"))
    return out.crossJoin(count(rt.searchable_units(spark, folder), "units"))


@add("usage_with_total", "SELECT coalesce(event_type, 'all') AS stage, count(*) AS records, round(sum(value), 3) AS total FROM (SELECT coalesce(event_type, 'unknown') AS event_type, value FROM events) GROUP BY ROLLUP (event_type)")
def usage_with_total(spark, folder):
    """Records and values per kind of event, and of all as stage ``all``."""
    e = table(spark, folder, "events").select(F.coalesce("event_type", F.lit("unknown")).alias("stage"), "value")
    return e.rollup("stage").agg(F.count("*").alias("records"), F.round(F.sum("value"), 3).alias("total")).select(F.coalesce("stage", F.lit("all")).alias("stage"), "records", "total")


@add("text_projection", f"WITH {rt.ITEMS} SELECT source_id, item_id, item_type, {rt._TEXT} AS text, ['text'] AS modalities FROM items WHERE {rt._TEXT} <> ''")
def text_projection(spark, folder):
    """Items as text alone: tables, formulas and images stand for their text; items without any are left out."""
    text = tx.item_text(F.col("raw_text"), F.col("caption"), F.col("search_text"))
    return rt.items_of(spark, folder).select("source_id", "item_id", "item_type", text.alias("text"), F.array(F.lit("text")).alias("modalities")).where("text <> ''")


@add("wiki_catalog", f"WITH {rt.PAGES} SELECT path, title, kind, coalesce(kind IN ('concept', 'entity', 'analysis') AND package_id IN (SELECT source_id FROM eval_cases WHERE source_id IS NOT NULL), false) AS update_eligible FROM nodes")
def wiki_catalog(spark, folder):
    """All pages, and whether a build that focuses on the sources of the cases may update them."""
    focus = rt.cases(spark, folder).select(F.col("source_id").alias("package_id")).distinct().withColumn("focus", F.lit(True))
    joined = pages_of(spark, folder).join(F.broadcast(focus), "package_id", "left")  # a stated set of cases
    return joined.select("path", "title", "kind", F.coalesce(F.col("kind").isin("concept", "entity", "analysis") & F.col("focus"), F.lit(False)).alias("update_eligible"))


@add("navigation_overview", f"WITH {rt.PAGES} SELECT CASE kind WHEN 'entity' THEN 'entities' WHEN 'analysis' THEN 'analyses' WHEN 'concept' THEN 'concepts' WHEN 'source' THEN 'sources' ELSE 'other' END AS directory, count(*) AS pages, min(title) AS first_title, max(title) AS last_title, count(DISTINCT package_id) AS sources FROM nodes GROUP BY 1")
def navigation_overview(spark, folder):
    """Pages by the directory of their kind."""
    names = {"entity": "entities", "analysis": "analyses", "concept": "concepts", "source": "sources"}
    directory = F.coalesce(F.create_map(*[F.lit(x) for p in names.items() for x in p])[F.col("kind")], F.lit("other"))
    return pages_of(spark, folder).groupBy(directory.alias("directory")).agg(F.count("*").alias("pages"), F.min("title").alias("first_title"), F.max("title").alias("last_title"), F.countDistinct("package_id").alias("sources"))


@add("asset_copies", f"WITH {rt.ASSETS}, {rt.ITEMS}, u AS (SELECT DISTINCT source_id, unnest(asset_ids) AS asset_id FROM items) SELECT source_id, asset_id, 'assets/' || source_id || '/' || asset_id || coalesce(regexp_extract(lower(path), '\\.[a-z0-9]+$'), '') AS vault_path FROM ast SEMI JOIN u USING (source_id, asset_id)")
def asset_copies(spark, folder):
    """Where the assets that items use are to be copied."""
    used = rt.items_of(spark, folder, ["asset_ids"]).select("source_id", F.explode("asset_ids").alias("asset_id"))
    own = rt.assets_of(spark, folder, ["path"]).join(used, ["source_id", "asset_id"], "left_semi")
    suffix = F.coalesce(F.regexp_extract(F.lower("path"), r"\.[a-z0-9]+$", 0), F.lit(""))
    return own.select("source_id", "asset_id", F.concat(F.lit("assets/"), "source_id", F.lit("/"), "asset_id", suffix).alias("vault_path"))


@add("source_names", "SELECT package_id, 'task-' || substr(sha256(coalesce(source_filename, '')), 1, 20) AS task_id, regexp_replace(coalesce(source_filename, ''), '(\\.(pdf|docx?|pptx?|xlsx?|png|jpe?g|html?|md|txt))+$', '', 'i') AS name FROM packages")
def source_names(spark, folder):
    """An id for the work on each file, and its name without known extensions."""
    f = tx.empty(F.col("source_filename"))
    return table(spark, folder, "packages").select("package_id", F.concat(F.lit("task-"), F.substring(F.sha2(f, 256), 1, 20)).alias("task_id"), F.regexp_replace(f, r"(?i)(\.(pdf|docx?|pptx?|xlsx?|png|jpe?g|html?|md|txt))+$", "").alias("name"))


# ---- staged builds ----------------------------------------------------------------------------------------------------
_SIGNED = "substr(sha256(coalesce(parser_name, '') || chr(10) || coalesce(parser_version, '') || chr(10) || coalesce(schema_version, '')), 1, 16)"
_STAGES = f"""cur AS (SELECT package_id AS source_id, source_version AS v, {_SIGNED} AS t, substr(sha256(coalesce(source_version, '') || chr(10) || 'visual'), 1, 16) AS x FROM packages),
sto AS (SELECT package_id AS source_id, CASE WHEN parser_version IS NULL THEN 'older' ELSE source_version END AS v, {_SIGNED} AS t, CASE WHEN title IS NOT NULL THEN substr(sha256(CASE WHEN parser_name IS NULL THEN 'x' ELSE coalesce(source_version, '') || chr(10) || 'visual' END), 1, 16) END AS x FROM packages WHERE ingested_at < TIMESTAMP '2025-01-01')"""


def stage_states(spark, folder):
    """The builds as of 2025 (packages without a parser version then had an older one) and what there is now."""
    p = table(spark, folder, "packages")
    text, visual = stages.signature(F.col("parser_name"), F.col("parser_version"), F.col("schema_version")), stages.signature(F.col("source_version"), F.lit("visual"))
    now = p.select(F.col("package_id").alias("source_id"), "source_version", text.alias("text_signature"), visual.alias("visual_signature"))
    version = F.when(F.col("parser_version").isNull(), "older").otherwise(F.col("source_version"))
    then = p.where("ingested_at < timestamp'2025-01-01'").select(F.col("package_id").alias("source_id"), version.alias("source_version"), text.alias("text_signature"), F.when(F.col("title").isNotNull(), F.when(F.col("parser_name").isNull(), stages.signature(F.lit("x"))).otherwise(visual)).alias("visual_signature"))
    return then, now


@add(
    "stage_plan",
    f"""WITH {_STAGES}, b AS (SELECT cur.source_id, cur.v IS NOT DISTINCT FROM sto.v AND coalesce(cur.t = sto.t, false) AS same, sto.x AS ox, cur.x AS x FROM cur LEFT JOIN sto USING (source_id))
SELECT source_id, CASE WHEN same THEN 'keep' ELSE 'build' END AS text_action, CASE WHEN NOT same THEN CASE WHEN ox IS NOT NULL THEN 'drop' ELSE 'wait' END WHEN coalesce(ox = x, false) THEN 'keep' ELSE 'build' END AS visual_action FROM b""",
)
def stage_plan(spark, folder):
    return stages.stage_plan(*stage_states(spark, folder))


@add("changed_sources", f"WITH {_STAGES} SELECT source_id, sto.v AS stored_version, cur.v AS current_version FROM sto JOIN cur USING (source_id) WHERE source_id NOT IN (SELECT source_id FROM eval_cases WHERE source_id IS NOT NULL AND modality = 'table') AND sto.v IS DISTINCT FROM cur.v")
def changed_sources(spark, folder):
    """Sources that a build for the cases on tables would keep although their version changed."""
    then, now = stage_states(spark, folder)
    return stages.changed_sources(then, now, rt.cases(spark, folder).where("modality = 'table'").select("source_id").distinct())


_PAGE_TEXT = "array_to_string(list_filter([coalesce(title, ''), coalesce(text, '')], lambda s: s <> ''), chr(10))"


@add("page_index", f"WITH {rt.PAGES}, r AS (SELECT path, {_PAGE_TEXT} AS t, updated_at FROM nodes) SELECT path, sha256(t) AS content_hash, {rt.sql_embedding('t')} AS vector, coalesce(updated_at < TIMESTAMP '2025-01-01', false) AS reused FROM r")
def page_index(spark, folder):
    """The index of pages as of 2025 brought up to date."""
    d = table(spark, folder, "documents").where("path is not null and path <> ''")
    nodes = d.groupBy("path").agg(F.min_by(F.struct("title", "text", "updated_at"), "doc_id").alias("f")).select("path", "f.*")
    before = stages.page_records(nodes.where("updated_at < timestamp'2025-01-01'"))
    return stages.update_page_index(before.withColumn("vector", vx.hash_embedding(F.col("text"))), stages.page_records(nodes))


@add(
    "visual_index",
    f"""WITH {rt._DERIVED}, k AS (SELECT a.source_id, a.asset_id, coalesce(a.vault_path, a.path) AS path, lower(trim(a.sha256)) AS sha256, a.ingested_at, p.source_version AS v, CASE WHEN p.parser_version IS NULL THEN 'older' ELSE p.source_version END AS ov FROM ast a LEFT JOIN packages p ON p.package_id = a.source_id WHERE a.sha256 IS NOT NULL AND EXISTS (SELECT 1 FROM derived d WHERE d.searchable AND d.source_id = a.source_id AND d.asset_id = a.asset_id))
SELECT source_id, asset_id, path, sha256, {rt.sql_embedding('sha256')} AS vector, ingested_at < TIMESTAMP '2025-01-01' AND v IS NOT DISTINCT FROM ov AS reused FROM k""",
)
def visual_index(spark, folder):
    """The index of visuals as of 2025 (packages without a parser version then had an older one) brought up to date."""
    assets, derived, packages = rt.assets_of(spark, folder, ["sha256", "path", "vault_path"]), rt.derived_of(spark, folder), table(spark, folder, "packages")
    older = packages.withColumn("source_version", F.when(F.col("parser_version").isNull(), "older").otherwise(F.col("source_version")))
    before = stages.visual_records(assets.where("ingested_at < timestamp'2025-01-01'"), derived, older).withColumn("vector", vx.hash_embedding(F.col("sha256")))
    return stages.update_visual_index(before, stages.visual_records(assets, derived, packages))
