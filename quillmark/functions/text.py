"""Column expressions on text: tokens, labels, excerpts, identifiers, tables, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the token and label patterns that ranking depends on
LATIN_TOKEN = r"[a-z0-9]+(?:[._/@+-][a-z0-9]+)*"
IDEOGRAPH = r"[\x{3400}-\x{9fff}]"
LATIN_LABEL = r"(?<![\p{L}\p{N}_])((?:figure|fig\.?|table|equation|eq\.?)\s*[a-z0-9.-]+)"
IDEOGRAPH_LABEL = r"((?:图|表|公式)\s*[a-z0-9.-]+)"
WIKI_LINK = r"(?:^|[^!])\[\[([^\]|#]+)(?:#[^\]|]*)?(?:\|[^\]]*)?\]\]"


def empty(text: Column) -> Column:
    """text, with null as the empty string."""
    return F.coalesce(text, F.lit(""))


def filled(*texts: Column) -> Column:
    """The first text that is neither null nor empty; the empty string where all are."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def collapse(text: Column) -> Column:
    """text with each run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(empty(text), r"\s+", " "))


def tokens(text: Column) -> Column:
    """The bag of tokens: Latin words with inner marks, then bigrams of ideograph runs (a lone sign as it is).

    Lower case stands for case folding; they differ only for letters like ß. Null gives no tokens.
    """
    lowered = F.lower(empty(text))
    latin = F.regexp_extract_all(lowered, F.lit(f"({LATIN_TOKEN})"), F.lit(1))
    # overlapping pairs by a look-ahead, which consumes nothing
    pairs = F.regexp_extract_all(lowered, F.lit(f"(?=({IDEOGRAPH}{IDEOGRAPH}))"), F.lit(1))
    alone = F.regexp_extract_all(lowered, F.lit(f"(?<!{IDEOGRAPH})({IDEOGRAPH})(?!{IDEOGRAPH})"), F.lit(1))
    return F.concat(latin, pairs, alone)


def labels(text: Column) -> Column:
    """The distinct labels of figures, tables and equations that a text names, in lower case."""
    lowered = F.lower(empty(text))
    return F.array_distinct(F.concat(*[F.regexp_extract_all(lowered, F.lit(p), F.lit(1)) for p in (LATIN_LABEL, IDEOGRAPH_LABEL)]))


def excerpt(clean: Column, query_tokens: Column, limit: int = 500) -> Column:
    """A window of about ``limit`` characters that starts a third before the first query token.

    ``clean`` is a column of collapsed text: a column, as it is read once per token.
    """
    places = F.filter(F.transform(query_tokens, lambda t: F.instr(F.lower(clean), t)), lambda p: p > 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(1)) - 1 - limit // 3)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(clean, start + 1, F.least(F.length(clean) - start, F.lit(limit))), F.when(start + limit < F.length(clean), "…").otherwise(""))
    # the window ends at start + limit
    return F.when(F.length(clean) <= limit, clean).otherwise(cut)


def item_text(raw: Column, caption: Column, search: Column) -> Column:
    """The text of an item: raw text, else caption, else search text; empty counts as missing."""
    return filled(raw, caption, search)


def document_text(*parts: Column) -> Column:
    """The parts that are not empty, one per line."""
    return F.array_join(F.filter(F.array(*[empty(p) for p in parts]), lambda x: x != ""), "\n")


def slug(text: Column) -> Column:
    """An identifier: runs of other signs than letters, digits, _ . - become -, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(empty(text)), r"(?U)[^\w.-]+", "-"), r"^[-_]+|[-_]+$", "")


def clean_html(html: Column) -> Column:
    """Text of HTML: tags as blanks, the five named entities and no-break blanks decoded, blanks collapsed."""
    text = F.regexp_replace(empty(html), r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return collapse(text)


def html_rows(html: Column) -> Column:
    """The cells of an HTML table as rows of texts; rows without cells are dropped."""
    rows = F.regexp_extract_all(empty(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), clean_html))
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_markdown(rows: Column) -> Column:
    """A pipe table; ragged rows are padded to the widest, the first row is the head; null or no rows give ''."""
    some = F.coalesce(rows, F.array().cast("array<array<string>>"))
    width = F.coalesce(F.array_max(F.transform(some, F.size)), F.lit(0))
    cell = lambda c: F.replace(collapse(c), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(some, line)
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def wiki_links(text: Column) -> Column:
    """Targets of wiki links in order, without anchors, titles and .md; embedded images are no links."""
    found = F.regexp_extract_all(empty(text), F.lit(WIKI_LINK), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"\.md$", "")), lambda x: x != "")


def evidence_id(source: Column, version: Column, item: Column) -> Column:
    return F.concat(source, F.lit("@"), version, F.lit("#"), item)


def number_citations(answer: Column, ids: Column) -> Column:
    """The answer with each cited id replaced by 〔n〕, longer ids first; n is the place in ``ids``."""
    places = F.transform(ids, lambda x, i: F.struct(F.length(x).alias("size"), i.alias("i"), x.alias("id")))
    ordered = F.array_sort(places, lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"]).otherwise(a["i"] - b["i"]))
    return F.aggregate(ordered, empty(answer), lambda s, x: F.replace(s, F.concat(F.lit("["), x["id"], F.lit("]")), F.concat(F.lit("〔"), (x["i"] + 1).cast("string"), F.lit("〕"))))


def covers_concepts(text: Column, groups: Column) -> Column:
    """Whether every group of aliases has one in the text, without case; no groups are covered."""
    return F.coalesce(F.forall(groups, lambda g: F.exists(g, lambda a: F.contains(F.lower(empty(text)), F.lower(a)))), F.lit(True))
