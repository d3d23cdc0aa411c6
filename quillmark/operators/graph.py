"""The graph of wiki links between pages: aliases, edges, authority, health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import empty, wiki_links
from quillmark.operators.skew import hot_keys, salted_left_join
from quillmark.session import cut_lineage


def nodes(documents: DataFrame) -> DataFrame:
    """doc_id, path, title, kind, text of the pages; pages without a path are none. Rows of one path: the least doc_id counts."""
    first = F.min(F.struct("doc_id", "title", "kind", "text")).alias("first")
    return documents.where("path is not null and path <> ''").groupBy("path").agg(first).select("path", "first.*")


def aliases(pages: DataFrame) -> DataFrame:
    """alias, path, ambiguous: the names a link may use (path without .md, its last part, the title), in lower case.

    ``path`` is the first page (least doc_id) with the name; ``ambiguous`` tells that several pages claim it.
    """
    bare = F.regexp_replace("path", r"\.md$", "")
    names = F.array_distinct(F.array(F.lower(bare), F.lower(F.regexp_extract(bare, r"([^/]*)$", 1)), F.lower(empty(F.col("title")))))
    each = pages.select("path", "doc_id", F.explode(names).alias("alias")).where("alias <> ''")
    return each.groupBy("alias").agg(F.min(F.struct("doc_id", "path")).alias("first"), (F.min("path") != F.max("path")).alias("ambiguous")).select("alias", "first.path", "ambiguous")


def links(pages: DataFrame, names: DataFrame, strict: bool = True) -> DataFrame:
    """source, link, target: each distinct link of each page; target null where the name is unknown or, if ``strict``, ambiguous.

    Names that very many links use are spread over several tasks.
    """
    raw = pages.select(F.col("path").alias("source"), F.explode(F.array_distinct(wiki_links(F.col("text")))).alias("link")).withColumn("alias", F.lower("link"))
    known = names.where(~F.col("ambiguous")) if strict else names
    hot = hot_keys(raw, ["alias"], pages.count())
    joined = salted_left_join(raw, known.select("alias", F.col("path").alias("target")), ["alias"], hot, "source")
    return joined.select("source", "link", "target")


def edges(found: DataFrame) -> DataFrame:
    """Distinct links between two different pages."""
    return found.where("target is not null and target <> source").select("source", "target").distinct()


def authority(pages: DataFrame, found: DataFrame) -> DataFrame:
    """path, inbound, authority: pages by the number of other pages that link to them."""
    inbound = edges(found).groupBy(F.col("target").alias("path")).agg(F.count("*").alias("inbound"))
    return pages.select("path").join(inbound, "path", "left").select("path", F.coalesce("inbound", F.lit(0)).alias("inbound"), F.round(F.lit(0.15) * F.log1p(F.coalesce("inbound", F.lit(0))), 6).alias("authority"))


def wanted(found: DataFrame) -> DataFrame:
    """link, pages: names that pages link to and no page answers to."""
    return found.where("target is null").groupBy("link").agg(F.countDistinct("source").alias("pages"))


def health(pages: DataFrame, names: DataFrame, found: DataFrame) -> DataFrame:
    """measure, value: size of the graph, orphans, wanted pages, ambiguous names. The links are found once."""
    found = cut_lineage(found)
    count = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("measure"), "value")
    every = count(pages, "nodes")
    for df, name in (
        (edges(found), "edges"),
        (authority(pages, found).where("inbound = 0"), "orphans"),
        (wanted(found), "wanted"),
        (names.where("ambiguous"), "ambiguous_names"),
        (pages.groupBy(F.lower("title").alias("t")).count().where("count > 1 and t is not null"), "duplicate_titles"),
    ):
        every = every.unionByName(count(df, name))
    return every
