"""Queries of ingestion, page checks, answers and streams, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import answers
from quillmark.functions import text as tx
from quillmark.functions import wiki
from quillmark.operators import fusion, graph, integrity, nearest, pages
from quillmark.functions import vectors as vx
from quillmark.plans import retrieval as rt
from quillmark.sources.packages import merge_parts, typed_records
from quillmark.sources.tables import table
from quillmark.streaming.ingest import stream_counts, stream_upsert

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return register


@add(
    "typed_items",
    """WITH r AS (SELECT raw_id, coalesce(json_valid(record), false) AS ok, CASE WHEN json_valid(record) THEN record::JSON END AS j FROM raw_items)
SELECT raw_id, NOT ok AS broken, j->>'$.item_id' AS item_id, try_cast(j->>'$.sequence' AS INT) AS sequence, coalesce(j->>'$.type', 'text') AS item_type, try_cast(j->>'$.page_start' AS INT) AS page_start, try_cast(j->>'$.page_end' AS INT) AS page_end,
j->>'$.content.raw_text' AS raw_text, CASE WHEN ok THEN array_to_string(list_sort(list_distinct(list_transform(json_extract(j, '$.assets[*]'), lambda x: coalesce(x->>'$.asset_id', x->>'$')))), ',') END AS assets FROM r""",
)
def typed_items(spark, folder):
    t = typed_records(table(spark, folder, "raw_items").select("raw_id", "record"))
    return t.select("raw_id", "broken", "item_id", "sequence", "item_type", "page_start", "page_end", "raw_text", F.when(~F.col("broken"), F.array_join(F.sort_array(F.coalesce("asset_ids", F.array().cast("array<string>"))), ",")).alias("assets"))


@add("broken_records", "SELECT package_id, line_no, raw_id, length(record) AS size FROM raw_items WHERE NOT coalesce(json_valid(record), false)")
def broken_records(spark, folder):
    t = typed_records(table(spark, folder, "raw_items").select("package_id", "line_no", "raw_id", F.length("record").alias("size"), "record"))
    return t.where("broken").select("package_id", "line_no", "raw_id", "size")


@add("search_texts", f"WITH {rt.ITEMS} SELECT source_id, item_id, array_to_string(list_filter(list_concat([coalesce(breadcrumb, ''), coalesce(nullif(raw_text, ''), caption, '')], coalesce(flatten(list_transform(table_rows[1:12], lambda r: list_transform(r[1:12], lambda c: coalesce(c, '')))), [])), lambda x: x <> ''), ' ') AS search_text FROM items")
def search_texts(spark, folder):
    i = rt.items_of(spark, folder, ["breadcrumb", "raw_text", "caption", "table_rows"])
    cells = F.flatten(F.transform("table_rows", lambda r: F.transform(r, tx.empty)))
    parts = F.concat(F.array(tx.empty(F.col("breadcrumb")), tx.filled(F.col("raw_text"), F.col("caption"))), F.coalesce(cells, F.array().cast("array<string>")))
    return i.select("source_id", "item_id", F.array_join(F.filter(parts, lambda x: x != ""), " ").alias("search_text"))


@add("box_systems", f"WITH {rt.ITEMS} SELECT coalesce(bbox.coordinate_system, 'none') AS declared, CASE WHEN list_max(list_transform(bbox.values, lambda v: abs(v))) <= 1 THEN 'normalized_1' ELSE 'normalized_1000' END AS inferred, count(*) AS items FROM items WHERE len(bbox.values) > 0 GROUP BY 1, 2")
def box_systems(spark, folder):
    i = rt.items_of(spark, folder, ["bbox"]).where("size(bbox.values) > 0")
    inferred = F.when(F.array_max(F.transform("bbox.values", F.abs)) <= 1, "normalized_1").otherwise("normalized_1000")
    return i.groupBy(F.coalesce("bbox.coordinate_system", F.lit("none")).alias("declared"), inferred.alias("inferred")).agg(F.count("*").alias("items"))


_RICH = "item_type IN ('image', 'figure', 'chart', 'table', 'equation', 'formula') OR coalesce(len(table_rows), 0) > 0 OR coalesce(table_html, '') <> '' OR coalesce(latex, '') <> '' OR coalesce(len(asset_ids), 0) > 0"


@add("item_flags", f"WITH {rt.ITEMS} SELECT source_id, item_id, {_RICH} AS rich, item_type NOT IN ('page_header', 'page_footer', 'page_number', 'page_aside_text') AND (coalesce(search_text, '') <> '' OR (item_type IN ('image', 'chart', 'figure', 'table') AND coalesce(len(asset_ids), 0) > 0)) AS searchable FROM items")
def item_flags(spark, folder):
    i = rt.items_of(spark, folder, ["item_type", "table_rows", "table_html", "latex", "asset_ids", "search_text"])
    many = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    some = lambda c: tx.empty(F.col(c)) != ""
    rich = F.col("item_type").isin("image", "figure", "chart", "table", "equation", "formula") | many("table_rows") | some("table_html") | some("latex") | many("asset_ids")
    found = ~F.col("item_type").isin("page_header", "page_footer", "page_number", "page_aside_text") & (some("search_text") | (F.col("item_type").isin("image", "chart", "figure", "table") & many("asset_ids")))
    return i.select("source_id", "item_id", rich.alias("rich"), found.alias("searchable"))


@add("path_problems", r"""SELECT source_id, asset_id, field, CASE WHEN trim(p) = '' THEN 'empty' WHEN regexp_matches(p, '^(/|[A-Za-z]:\\)') THEN 'absolute' WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'scheme' WHEN regexp_matches(p, '(^|[/\\])\.\.([/\\]|$)') THEN 'outside' END AS problem
FROM (SELECT DISTINCT source_id, asset_id, unnest(['path', 'vault_path']) AS field, coalesce(unnest([path, vault_path]), '') AS p FROM assets) WHERE problem IS NOT NULL""")
def path_problems(spark, folder):
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("p")) for c in ("path", "vault_path")])
    rows = table(spark, folder, "assets").select("source_id", "asset_id", F.inline(each)).select("source_id", "asset_id", "field", tx.empty(F.col("p")).alias("p")).distinct()
    return rows.select("source_id", "asset_id", "field", wiki.path_problem(F.col("p")).alias("problem")).where("problem is not null")


@add(
    "merged_parts",
    f"""WITH {rt.ITEMS}, sz AS (SELECT source_id, coalesce(max(page_start), 0) AS pages, max(coalesce(sequence, 0)) AS rows FROM items GROUP BY 1),
sh AS (SELECT p.package_id AS source_id, parser_name, coalesce(sum(pages) OVER w, 0)::INT AS ps, coalesce(sum(rows) OVER w, 0)::INT AS rs FROM packages p JOIN sz ON sz.source_id = p.package_id WINDOW w AS (PARTITION BY parser_name ORDER BY p.package_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT parser_name, CASE WHEN regexp_matches(item_id, '^item-p\\d+-b\\d+$') THEN 'item-p' || CASE WHEN regexp_extract(item_id, '^item-p(\\d+)-b(\\d+)$', 1)::INT + ps > 9999 THEN substr((regexp_extract(item_id, '^item-p(\\d+)-b(\\d+)$', 1)::INT + ps)::VARCHAR, 1, 4) ELSE lpad((regexp_extract(item_id, '^item-p(\\d+)-b(\\d+)$', 1)::INT + ps)::VARCHAR, 4, '0') END || '-b' || regexp_extract(item_id, '^item-p(\\d+)-b(\\d+)$', 2) ELSE item_id END AS merged_id, coalesce(sequence, 0) + rs AS sequence, page_start + ps AS page_start, source_id, item_id FROM items JOIN sh USING (source_id)""",
)
def merged_parts(spark, folder):
    return merge_parts(table(spark, folder, "packages").select("package_id", "parser_name"), rt.items_of(spark, folder, ["sequence", "page_start"]).drop("ingested_at"), "parser_name")


_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@add(
    "clean_pages",
    f"""WITH a AS (SELECT doc_id, coalesce(title, '') AS title, {_STRIP("coalesce(text, '')")} AS b FROM documents), c AS (SELECT doc_id, title, regexp_replace(b, '(?s)^(?:---\\n.*?\\n---\\s*)+', '') AS b FROM a),
d AS (SELECT doc_id, title, {_STRIP("regexp_replace(b, '(?ms)^---\\n.*?^---\\n?', '', 'g')")} AS b FROM c), e AS (SELECT doc_id, title, regexp_replace(regexp_replace(b, '{wiki.MANAGED_START}', ''), '(?s)\\n## Evidence\\n.*$', '') AS b FROM d),
l AS (SELECT doc_id, string_split(b, chr(10)) AS ls, list_transform(string_split(b, chr(10)), lambda x: trim(x) = '' OR lower(trim(x)) = lower('# ' || title)) AS flags FROM e), k AS (SELECT doc_id, ls, coalesce(list_position(flags, false), 0) AS first FROM l)
SELECT doc_id, regexp_replace(CASE WHEN first > 0 THEN {_STRIP("array_to_string(ls[first:], chr(10))")} ELSE '' END, '\\[\\[([^\\[\\]\\s]+@[^#\\[\\]]+#[^\\[\\]]+)\\]\\]', '`\\1`', 'g') AS text FROM k""",
)
def clean_pages(spark, folder):
    return table(spark, folder, "documents").select("doc_id", wiki.clean_page(F.col("text"), F.col("title")).alias("text"))


@add(
    "lint_report",
    f"""WITH {rt._LINKS} SELECT 'error' AS severity, 'kind' AS rule, path AS record FROM nodes WHERE kind IS NULL OR kind NOT IN ('concept', 'entity', 'analysis', 'source', 'external_markdown')
UNION ALL SELECT 'error', 'no_source', path FROM nodes WHERE package_id IS NULL UNION ALL SELECT 'error', 'unknown_source', path FROM nodes WHERE package_id IS NOT NULL AND package_id NOT IN (SELECT package_id FROM packages)
UNION ALL SELECT 'error', 'no_text', path FROM nodes WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'warning', 'no_title', path FROM nodes WHERE trim(coalesce(title, '')) = ''
UNION ALL SELECT 'warning', 'repeated_heading', path FROM nodes WHERE len(list_filter(string_split(lower(coalesce(text, '')), chr(10)), lambda x: trim(x) = lower('# ' || coalesce(title, '')))) > 1
UNION ALL SELECT 'warning', 'orphan', path FROM nodes WHERE path NOT IN (SELECT target FROM edges) UNION ALL SELECT DISTINCT 'warning', 'broken_link', source FROM found WHERE target IS NULL
UNION ALL SELECT 'warning', 'uncovered_source', package_id FROM packages WHERE package_id NOT IN (SELECT package_id FROM documents WHERE package_id IS NOT NULL)""",
)
def lint_report(spark, folder):
    docs, packages = table(spark, folder, "documents"), table(spark, folder, "packages")
    first = F.min(F.struct("doc_id", "title", "kind", "text", "package_id")).alias("f")
    nodes = docs.where("path is not null and path <> ''").groupBy("path").agg(first).select("path", "f.*")
    names = graph.aliases(nodes)
    found = graph.links(nodes, names)
    blank = lambda c: F.trim(tx.empty(F.col(c))) == ""
    path = F.col("path")
    return integrity.findings(
        ("error", "kind", nodes.where(~F.coalesce(F.col("kind").isin(wiki.KINDS), F.lit(False))), path),
        ("error", "no_source", nodes.where("package_id is null"), path),
        ("error", "unknown_source", nodes.where("package_id is not null").join(packages.select("package_id"), "package_id", "left_anti"), path),
        ("error", "no_text", nodes.where(blank("text")), path),
        ("warning", "no_title", nodes.where(blank("title")), path),
        ("warning", "repeated_heading", nodes.where(wiki.repeats_title(F.col("text"), F.col("title"))), path),
        ("warning", "orphan", graph.authority(nodes, found).where("inbound = 0"), path),
        ("warning", "broken_link", found.where("target is null").select("source").distinct(), F.col("source")),
        ("warning", "uncovered_source", packages.join(docs.select("package_id"), "package_id", "left_anti"), F.col("package_id")),
    )


@add(
    "source_audit",
    f"""WITH {rt.ITEMS}, {rt.CHUNKS}, i AS (SELECT source_id, count(*) AS items, count(*) FILTER (page_start >= 1) AS located, count(*) FILTER ({_RICH}) AS rich FROM items GROUP BY 1), c AS (SELECT source_id, count(*) FILTER (coalesce(text, '') <> '') AS texts FROM cs GROUP BY 1), d AS (SELECT package_id AS source_id, count(*) AS pages FROM documents GROUP BY 1)
SELECT p.package_id AS source_id, coalesce(items, 0) > 0 AS has_items, coalesce(texts, 0) > 0 AS has_chunks, coalesce(pages, 0) > 0 AS has_pages, coalesce(items, 0) = coalesce(located, 0) AS all_located, coalesce(rich, 0) > 0 AS has_rich, coalesce(p.title, '') <> '' AS titled FROM packages p LEFT JOIN i ON i.source_id = p.package_id LEFT JOIN c ON c.source_id = p.package_id LEFT JOIN d ON d.source_id = p.package_id""",
)
def source_audit(spark, folder):
    flags = item_flags(spark, folder)
    located = rt.items_of(spark, folder, ["page_start"]).groupBy("source_id").agg(F.count("*").alias("items"), F.count_if(F.col("page_start") >= 1).alias("located"))
    rich = flags.groupBy("source_id").agg(F.count_if("rich").alias("rich"))
    texts = rt.chunks_of(spark, folder, ["text"]).groupBy("source_id").agg(F.count_if(tx.empty(F.col("text")) != "").alias("texts"))
    docs = table(spark, folder, "documents").groupBy(F.col("package_id").alias("source_id")).agg(F.count("*").alias("pages"))
    base = table(spark, folder, "packages").select(F.col("package_id").alias("source_id"), "title")
    for df in (located, rich, texts, docs):
        base = base.join(df, "source_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return base.select("source_id", (n("items") > 0).alias("has_items"), (n("texts") > 0).alias("has_chunks"), (n("pages") > 0).alias("has_pages"), (n("items") == n("located")).alias("all_located"), (n("rich") > 0).alias("has_rich"), (tx.empty(F.col("title")) != "").alias("titled"))


@add("stale_pages", "WITH " + rt.PAGES + ", v AS (SELECT n.path, n.package_id, CASE WHEN p.parser_version IS NULL THEN 'older' ELSE p.source_version END AS known, p.source_version AS current FROM nodes n JOIN packages p USING (package_id)) SELECT path, package_id AS source_id, current FROM v WHERE current IS NOT NULL AND known IS DISTINCT FROM current")
def stale_pages(spark, folder):
    """Pages as built when packages without a parser version had an older version."""
    packages = table(spark, folder, "packages")
    then = packages.select("package_id", F.when(F.col("parser_version").isNull(), "older").otherwise(F.col("source_version")).alias("known"))
    first = F.min(F.struct("doc_id", "package_id")).alias("f")
    nodes = table(spark, folder, "documents").where("path is not null and path <> ''").groupBy("path").agg(first).select("path", "f.package_id").where("package_id is not null")
    built = nodes.join(then, "package_id").select("path", F.array("package_id").alias("source_ids"), F.array("known").alias("source_versions"))
    return pages.stale_pages(built, packages.select(F.col("package_id").alias("source_id"), "source_version"))


@add(
    "page_rrf",
    f"WITH {rt._LOOSE}, " + rt.sql_bm25(rt._QUESTIONS, rt._PAGE_DOCS, k=20, more="CASE WHEN list_has_any(qlabs, labs) THEN 6 ELSE 0 END")
    + f""", pv AS (SELECT path, {rt.sql_embedding("array_to_string(list_filter([coalesce(title, ''), coalesce(text, '')], lambda s: s <> ''), chr(10))")} AS v FROM nodes), eq AS (SELECT id AS query_id, {rt.sql_embedding('question')} AS v FROM eval_cases),
es AS (SELECT query_id, path, round(list_cosine_similarity(eq.v, pv.v), 6) AS score FROM eq, pv), er AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM es QUALIFY rank <= 20),
f AS (SELECT query_id, path, round(sum(1.0::DOUBLE / (60 + rank)) * 1000, 6) AS score, list(channel ORDER BY channel) AS channels FROM (SELECT query_id, substr(doc_key, 2) AS path, rank, 'page_bm25' AS channel FROM ranked UNION ALL SELECT query_id, path, rank, 'page_embedding' FROM er) GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank, path, score, channels FROM f QUALIFY rank <= 8""",
)
def page_rrf(spark, folder):
    """Pages by fused lexical and vector ranks."""
    nodes = rt.pages_of(spark, folder)
    vectors = nodes.select(F.col("path").alias("vec_id"), vx.hash_embedding(tx.document_text(F.col("title"), F.col("text"))).alias("vector"))
    asked = rt.cases(spark, folder).select(F.col("id").alias("query_id"), vx.hash_embedding(F.col("question")).alias("vector"))
    near = nearest.nearest(asked, vectors, 20, skip_self=False).select("query_id", "rank", F.col("vec_id").alias("path"), "score")
    return fusion.fuse({"page_bm25": rt.ranked_pages(spark, folder, k=20), "page_embedding": near}, "path", 8)


_BEST3 = rt._CHUNK_RANK + ", h AS (SELECT query_id, rank, doc_key, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS text FROM ranked JOIN cs ON cs.source_id || '#' || cs.chunk_id = doc_key WHERE rank <= 3)"


@add(
    "cited_answers",
    _BEST3
    + """, a AS (SELECT query_id, string_agg('- ' || text || ' [' || doc_key || ']', chr(10) ORDER BY rank) AS answer, list(doc_key ORDER BY rank) AS ids FROM h GROUP BY 1)
SELECT query_id, replace(replace(replace(answer, '[' || ids[1] || ']', '〔1〕'), '[' || coalesce(ids[2], '?') || ']', '〔2〕'), '[' || coalesce(ids[3], '?') || ']', '〔3〕') AS answer, ids AS citations FROM a""",
)
def cited_answers(spark, folder):
    """The offline answer to each case: the texts of its best three hits, each with its id, cited by number."""
    hits = rt.bm25_chunk_topk(spark, folder).where("rank <= 3")
    texts = rt.chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), tx.collapse(F.col("text")).alias("text"))
    lines = hits.join(texts, "doc_key").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_key", "text"))).alias("h"))  # three rows at most
    ids = F.transform("h", lambda x: x.doc_key)
    answer = F.array_join(F.transform("h", lambda x: F.concat(F.lit("- "), x.text, F.lit(" ["), x.doc_key, F.lit("]"))), "\n")
    return lines.select("query_id", tx.number_citations(answer, ids).alias("answer"), ids.alias("citations"))


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_PLAIN_ANSWER = lambda x: f"regexp_replace(lower(translate(coalesce({x}, ''), '{_WIDE[0]}', '{_WIDE[1]}')), '[\\s\\x{{3000}}，。；：、,.!?！？;:''\"“”‘’（）()\\[\\]【】]+', '', 'g')"
_OVERLAP = rt._CHUNK_RANK + f""", best AS (SELECT query_id AS id, coalesce(text, '') AS found FROM ranked JOIN cs ON cs.source_id || '#' || cs.chunk_id = doc_key WHERE rank = 1),
o AS (SELECT e.id, e.expected_answer, found, {_PLAIN_ANSWER('expected_answer')} AS a, {_PLAIN_ANSWER('found')} AS b, round(length(coalesce(found, '')) / greatest(length(coalesce(expected_answer, '')), 1), 4) AS ratio FROM eval_cases e LEFT JOIN best b ON b.id = e.id)"""


@add("answer_overlap", _OVERLAP + " SELECT id, a = b AS exact, a <> '' AND contains(b, a) AS contained, ratio AS length_ratio FROM o")
def answer_overlap(spark, folder):
    """How the best hit's text compares with the expected answer, without case, width, blanks and punctuation."""
    best = rt.bm25_chunk_topk(spark, folder).where("rank = 1")
    texts = rt.chunks_of(spark, folder, ["text"]).select(F.concat_ws("#", "source_id", "chunk_id").alias("doc_key"), F.col("text").alias("found"))
    joined = rt.cases(spark, folder).select("id", "expected_answer").join(best.join(texts, "doc_key").select(F.col("query_id").alias("id"), "found"), "id", "left")
    a, b = answers.normalized_answer(F.col("expected_answer")), answers.normalized_answer(F.col("found"))
    flat = joined.select("id", "expected_answer", "found", a.alias("a"), b.alias("b"))
    ratio = F.round(F.length(tx.empty(F.col("found"))) / F.greatest(F.length(tx.empty(F.col("expected_answer"))), F.lit(1)), 4)
    return flat.select("id", (F.col("a") == F.col("b")).alias("exact"), ((F.col("a") != "") & F.contains("b", "a")).alias("contained"), ratio.alias("length_ratio"))


@add(
    "normalized_math",
    f"WITH {rt.ITEMS} SELECT source_id, item_id, coalesce(raw_text, '') || CASE WHEN coalesce(latex, '') <> '' THEN ' ' || chr(10) || '$$' || chr(10) || trim(latex) || chr(10) || '$$' || chr(10) ELSE '' END AS text FROM items WHERE regexp_matches(coalesce(raw_text, ''), '[$\\\\]') OR coalesce(latex, '') <> ''",
)
def normalized_math(spark, folder):
    """Texts that hold formula delimiters, and those with a formula beside them, which is put in brackets; all in one form.

    The dollars in the given texts enclose no formulas, so the SQL leaves them.
    """
    i = rt.items_of(spark, folder, ["raw_text", "latex"])
    formula = tx.empty(F.col("latex"))
    whole = F.concat(tx.empty(F.col("raw_text")), F.when(formula != "", F.concat(F.lit(r" \["), formula, F.lit(r"\]"))).otherwise(""))
    return i.where(tx.empty(F.col("raw_text")).rlike(r"[$\\]") | (formula != "")).select("source_id", "item_id", answers.normalized_math(whole).alias("text"))


@add("repaired_records")
def repaired_records(spark, folder):
    """The JSON object that each raw record holds, read leniently; null where there is none."""
    return table(spark, folder, "raw_items").select("raw_id", answers.repaired_json(F.col("record")).alias("record"))


@add("streamed_chunks", f"WITH {rt.CHUNKS} SELECT source_id, chunk_id, ingested_at, sha256(coalesce(text, '')) AS content_hash FROM cs")
def streamed_chunks(spark, folder):
    rows = stream_upsert(spark, f"{folder}/chunks.parquet", ["source_id", "chunk_id"], ["text"])
    return rows.select("source_id", "chunk_id", "ingested_at", F.sha2(tx.empty(F.col("text")), 256).alias("content_hash"))


@add("streamed_event_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def streamed_event_counts(spark, folder):
    return stream_counts(spark, f"{folder}/events.parquet", "ts", "event_type")
