"""Parser block lists (three layouts) as rows, and from rows to items."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillmark.functions.text import html_rows

VISUALS = ["image", "chart", "table"]
FRAME = ["page_header", "page_footer", "page_number", "page_aside_text"]
CELLS = 12


def preferred_files(paths: DataFrame) -> DataFrame:
    """Of the block lists of one directory and stem (column path), the newer format where there are both."""
    name = F.regexp_extract("path", r"^(.*?)_content_list(_v2)?\.json$", 1)
    newer = F.when(F.col("path").endswith("_v2.json"), 0).otherwise(1)
    found = paths.where(F.col("path").rlike(r"_content_list(_v2)?\.json$"))
    return found.groupBy(name.alias("stem")).agg(F.min(F.struct(newer.alias("n"), "path")).alias("f")).select("stem", "f.path")


def read_block_lists(spark: SparkSession, root: str) -> DataFrame:
    """stem, document: the preferred block list files anywhere under ``root``, whole."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*_content_list*.json").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))
    return files.join(preferred_files(files.select("path")), "path").select("stem", "document")


def blocks(lists: DataFrame) -> DataFrame:
    """stem, page_number, block_index, raw_ref, sequence, block (JSON text) of each block.

    A list holds pages (lists of blocks, or objects with content_list, blocks or items), or blocks with page_idx; it may lie
    in an object under ``pages``. Elements that are no objects are left out but keep their number.
    """
    whole = F.coalesce(F.get_json_object("document", "$.pages"), F.col("document"))
    top = lists.select("stem", F.posexplode(F.from_json(whole, "array<string>")).alias("page", "entry"))
    entries = F.coalesce(F.get_json_object("entry", "$.content_list"), F.get_json_object("entry", "$.blocks"), F.get_json_object("entry", "$.items"), F.when(F.trim("entry").startswith("["), F.col("entry")))
    split = top.withColumn("entries", F.from_json(entries, "array<string>")).withColumn("idx", F.expr("try_cast(get_json_object(entry, '$.page_idx') as int)"))
    paged = split.where("entries is not null").select("stem", "page", "idx", F.posexplode("entries").alias("at", "block"))
    a = paged.where(F.trim("block").startswith("{")).select("stem", (F.coalesce(F.col("idx"), F.col("page")) + 1).alias("page_number"), (F.col("at") + 1).alias("block_index"), F.format_string("content_list_v2[%d][%d]", "page", "at").alias("raw_ref"), F.struct("page", "at").alias("order"), "block")
    flat = split.where(F.col("entries").isNull() & F.trim("entry").startswith("{")).select("stem", "page", F.coalesce(F.col("idx") + 1, F.lit(1)).alias("page_number"), "entry")
    from pyspark.sql import Window

    on_page = Window.partitionBy("stem", "page_number").orderBy("page")
    b = flat.select("stem", "page_number", F.row_number().over(on_page).alias("block_index"), F.format_string("content_list[%d]", "page").alias("raw_ref"), F.struct(F.col("page"), F.lit(0).alias("at")).alias("order"), F.col("entry").alias("block"))
    every = a.unionByName(b)
    return every.withColumn("sequence", F.row_number().over(Window.partitionBy("stem").orderBy("order"))).drop("order")


def field(*paths: str) -> Column:
    """The first JSON path of a block that has a value."""
    return F.coalesce(*[F.nullif(F.get_json_object("block", p), F.lit("")) for p in paths])


def leaf_text(json_text: str | None) -> str:
    """The texts in a nested value, in order: strings, lists, and objects with content, children or text, at any depth."""
    if json_text is None or not json_text.strip():
        return ""
    if json_text.lstrip()[0] not in "[{":
        return json_text.strip()
    try:
        todo = [json.loads(json_text)]
    except ValueError:
        return json_text.strip()
    out = []
    while todo:
        value = todo.pop()
        if isinstance(value, str):
            out.append(value.strip())
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            todo.append(next((value[k] for k in ("content", "children", "text") if value.get(k)), None))
    return "".join(out).strip()


@F.pandas_udf(StringType())
def inline_text(values: pd.Series) -> pd.Series:
    """Text of nested content, see leaf_text; a value nested beyond what the JSON parser reads (thousands of levels) fails."""
    return values.map(leaf_text)


def kind_of(kind: Column, level: Column) -> Column:
    """The item type of a block type; text with a level is a title."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit("text"))))
    return (
        F.when((k == "text") & (F.coalesce(level, F.lit(0)) > 0), "title").when(k == "text", "paragraph").when(k.isin("equation_interline", "interline_equation"), "equation")
        .when(k == "header", "page_header").when(k == "footer", "page_footer").when(k == "aside_text", "page_aside_text").otherwise(k)
    )


def items_of_blocks(rows: DataFrame) -> DataFrame:
    """Items of blocks: type, text, caption, table, section path, search text, box system, whether searchable."""
    level = F.expr("try_cast(get_json_object(block, '$.text_level') as int)")
    kind = kind_of(F.get_json_object("block", "$.type"), level)
    typed = rows.withColumn("item_type", kind).withColumn("level", F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.expr("try_cast(get_json_object(block, '$.content.level') as int)"), level, F.lit(1)))))
    text = (
        F.when(F.col("item_type") == "title", inline_text(field("$.content.title_content", "$.text")))
        .when(F.col("item_type") == "paragraph", inline_text(field("$.content.paragraph_content", "$.text")))
        .when(F.col("item_type") == "equation", inline_text(field("$.content.math_content", "$.text", "$.latex")))
        .when(F.col("item_type") == "code", inline_text(field("$.content.code_content", "$.code_body")))
        .otherwise(inline_text(field("$.content.content", "$.text")))
    )
    caption = F.coalesce(*[F.when(F.col("item_type") == k, inline_text(field(f"$.content.{k}_caption", f"$.{k}_caption"))) for k in ("image", "chart", "table", "code")], F.lit(""))
    html = F.when(F.col("item_type") == "table", field("$.content.html", "$.content.table_body", "$.table_body"))
    told = typed.select("stem", "page_number", "block_index", "raw_ref", "sequence", "item_type", "level", text.alias("text"), caption.alias("caption"), F.coalesce(html, F.lit("")).alias("table_html"), F.from_json(F.get_json_object("block", "$.bbox"), "array<double>").alias("box"), field("$.img_path", "$.content.image_path", "$.image_path").alias("image"))
    # the stack of headings: a fold over the titles of a document, then each block takes the last path before it
    from pyspark.sql import Window

    titles = told.where("item_type = 'title'").groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("sequence", "level", "text"))).alias("t"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<sequence:int,path:string>>").alias("out"))

    def push(state, x):
        cut = F.slice(state["stack"], F.lit(1), F.least(x["level"] - 1, F.size(state["stack"])))
        stack = F.when(x["text"] != "", F.concat(cut, F.array(x["text"]))).otherwise(cut)
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(x["sequence"].alias("sequence"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    paths = titles.select("stem", F.inline(F.aggregate("t", start, push, lambda s: s["out"])))
    last = F.last("path", ignorenulls=True).over(Window.partitionBy("stem").orderBy("sequence").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = told.join(paths, ["stem", "sequence"], "left").withColumn("breadcrumb", F.coalesce(last, F.lit(""))).drop("path")
    raw = F.coalesce(F.nullif("text", F.lit("")), F.col("caption"))
    cells = F.flatten(F.transform(F.slice(html_rows(F.col("table_html")), 1, CELLS), lambda r: F.slice(r, 1, CELLS)))
    extra = F.when(F.size(cells) > 0, cells).otherwise(F.array("table_html"))
    search = F.trim(F.array_join(F.filter(F.concat(F.array("breadcrumb", raw), extra), lambda x: x != ""), " "))
    system = F.when((F.size("box") > 0) & (F.array_max(F.transform("box", F.abs)) <= 1), "normalized_1").otherwise("normalized_1000")
    done = placed.select(
        "stem", F.format_string("item-p%04d-b%04d", "page_number", "block_index").alias("item_id"), "sequence", "item_type", "page_number", "breadcrumb", raw.alias("raw_text"), "caption", "table_html",
        search.alias("search_text"), system.alias("coordinate_system"), "raw_ref", "image",
    )
    return done.withColumn("searchable", ~F.col("item_type").isin(FRAME) & ((F.col("search_text") != "") | (F.col("item_type").isin(VISUALS) & F.col("image").isNotNull())))
