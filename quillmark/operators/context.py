"""Where items lie and what lies around them: locators, neighbours, sections, context of visuals, selected evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import empty, item_text
from quillmark.operators.order import positions, running_sum, top_rows
from quillmark.operators.skew import hot_keys, salted_left_join
from quillmark.sources.tables import earliest

PARAGRAPHS = ["paragraph", "page_aside_text", "page_footnote"]
VISUALS = ["image", "figure", "chart", "table"]
# fixed values: names of the parts of a page
PART_NAMES = {
    "paragraph": "正文段落", "page_aside_text": "旁注段落", "page_footnote": "脚注段落", "title": "标题", "image": "图片区域", "figure": "图片区域", "chart": "图表区域",
    "table": "表格区域", "equation": "公式区域", "formula": "公式区域", "page_header": "页眉", "page_footer": "页脚", "page_number": "页码",
}
PART_ROWS, PART_LETTERS = 500, 12
ITEM_COLUMNS = ["source_version", "sequence", "item_type", "page_start", "breadcrumb", "raw_text", "caption", "search_text", "provenance", "asset_ids"]


def current_items(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per item (its earliest) with the columns ``keep``."""
    return earliest(items, ["source_id", "item_id"], keep or ITEM_COLUMNS)


def stretch(sequence: Column) -> Column:
    """The range of a sequence that a row lies in; few rows each."""
    return F.floor(F.coalesce(sequence, F.lit(0)) / PART_ROWS)


def part_of_order(sequence: Column, item: Column) -> Column:
    """A leading part of the order by (sequence, item): the range of the sequence, and for items without a sequence (or at 0)
    the first letters of the item, so that a source without sequences is not one part."""
    none = F.coalesce(sequence, F.lit(0)) == 0
    return F.struct(stretch(sequence).alias("range"), (~none).alias("placed"), F.when(none, F.substring(item, 1, PART_LETTERS)).otherwise("").alias("letters"))


def placed_items(items: DataFrame) -> DataFrame:
    """Items with their position in the source, by (sequence, item_id)."""
    return positions(items, ["source_id"], part_of_order(F.col("sequence"), F.col("item_id")), [F.coalesce("sequence", F.lit(0)), "item_id"])


def locators(items: DataFrame) -> DataFrame:
    """Page, block and paragraph number of each item, with a label.

    A page below 1 or null leaves the item unlocated (all numbers null). Blocks are numbered by the raw reference or the
    item id, else by order on the page; paragraphs by order among the paragraphs of the page.
    """
    located = items.withColumn("page_number", F.when(F.col("page_start") >= 1, F.col("page_start")))
    paragraph = F.col("item_type").isin(PARAGRAPHS)
    group, coarse, order = ["source_id", "page_number"], part_of_order(F.col("sequence"), F.col("item_id")), [F.coalesce("sequence", F.lit(0)), "item_id"]
    counted = running_sum(located, group, coarse, order, F.lit(1), "on_page")
    counted = running_sum(counted, group, coarse, order, paragraph.cast("int"), "paragraphs")
    ref, own = empty(F.col("provenance.raw_ref")), empty(F.col("item_id"))
    number = lambda text, pattern, i: F.expr("null").cast("int") if pattern is None else F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i).cast("int"))
    by_ref, by_id = r"\[(\d+)\]\[(\d+)\]", r"-p(\d+)-b(\d+)$"
    page_index = F.coalesce(number(ref, by_ref, 1), F.greatest(F.lit(0), number(own, by_id, 1) - 1), F.col("page_number") - 1)
    block = F.coalesce(number(ref, by_ref, 2) + 1, F.greatest(F.lit(0), number(own, by_id, 2) - 1) + 1, F.col("on_page").cast("int"))
    names = F.create_map(*[F.lit(x) for pair in PART_NAMES.items() for x in pair])
    there = F.col("page_number").isNotNull()
    rows = counted.select(
        "source_id", "item_id", "item_type", "page_number",
        F.when(there, page_index).alias("page_index"),
        F.when(there, block).alias("block_index"),
        F.when(there & paragraph, F.col("paragraphs").cast("int")).alias("paragraph_index"),
    )
    part = F.when(F.col("paragraph_index").isNotNull(), F.concat(F.lit("第 "), F.col("paragraph_index"), F.lit(" 段"))).otherwise(F.coalesce(names[F.col("item_type")], F.concat(F.lit("第 "), F.col("block_index"), F.lit(" 个内容块"))))
    return rows.withColumn("label", F.when(there, F.concat(F.lit("第 "), F.col("page_number"), F.lit(" 页 · "), part)))


def shifted(placed: DataFrame, by: int, columns: dict[str, str]) -> DataFrame:
    """The rows to be joined as the ones ``by`` places away: source_id, position and the renamed columns."""
    return placed.select("source_id", (F.col("position") - by).alias("position"), *[F.col(c).alias(n) for c, n in columns.items()])


def relations(placed: DataFrame) -> DataFrame:
    """Each item with the ids of the items before and after it in its source."""
    before, after = shifted(placed, -1, {"item_id": "previous_item_id"}), shifted(placed, 1, {"item_id": "next_item_id"})
    return placed.select("source_id", "position", "item_id").join(before, ["source_id", "position"], "left").join(after, ["source_id", "position"], "left")


def neighbours(placed: DataFrame, longest: int = 80) -> DataFrame:
    """source_id, item_id, neighbour_id, side: items beside a short item, on its page and in its section."""
    text = F.trim(item_text(F.col("raw_text"), F.col("caption"), F.col("search_text")))
    short = placed.where(F.length(text) <= longest).select("source_id", "item_id", "page_start", empty(F.col("breadcrumb")).alias("section"), "position", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"))
    other = placed.select("source_id", F.col("position").alias("at"), F.col("item_id").alias("neighbour_id"), F.col("page_start").alias("page2"), empty(F.col("breadcrumb")).alias("section2"))
    short = short.withColumn("at", F.col("position") + F.col("side"))
    joined = short.join(other, ["source_id", "at"])
    return joined.where(F.col("page_start").eqNullSafe(F.col("page2")) & (F.col("section") == F.col("section2"))).select("source_id", "item_id", "neighbour_id", "side")


def sections(items: DataFrame, total: int = 0) -> DataFrame:
    """Membership of items in sections (same source, page and breadcrumb): section_id, members, source_id, item_id.

    Siblings are the items of one section; they are given as groups, not as pairs. Very large sections are spread over
    several tasks (``total``: number of items, if known).
    """
    key = F.sha2(F.concat_ws("\n", "source_id", F.coalesce(F.col("page_start").cast("string"), F.lit("")), empty(F.col("breadcrumb"))), 256)
    tagged = items.select("source_id", "item_id", key.alias("section_id"))
    sizes = tagged.groupBy("section_id").agg(F.count("*").alias("members"))
    return salted_left_join(tagged, sizes, ["section_id"], hot_keys(tagged, ["section_id"], total), "item_id")


def visual_context(placed: DataFrame, reach: int = 3, budget: int = 1200) -> DataFrame:
    """source_id, item_id, context_item_ids, context: the text around each visual.

    Neighbours up to ``reach`` places away, on the same page, in the same or an unnamed section, that are text, in reading
    order, until ``budget`` characters are used; the last is clipped. Visuals without such neighbours have an empty context.
    """
    visuals = placed.where(F.col("item_type").isin(VISUALS))
    steps = [d for d in range(-reach, reach + 1) if d]
    wide = visuals.select("source_id", "item_id", "page_start", empty(F.col("breadcrumb")).alias("section"), F.explode(F.array(*[F.lit(d) for d in steps])).alias("step"), "position").withColumn("at", F.col("position") + F.col("step"))
    text = F.trim(empty(F.col("raw_text")))
    other = placed.where(~F.coalesce(F.col("item_type").isin([*VISUALS, "equation", "title"]), F.lit(False)) & (text != "")).select("source_id", F.col("position").alias("at"), F.col("item_id").alias("other_id"), F.col("page_start").alias("page2"), empty(F.col("breadcrumb")).alias("section2"), text.alias("text"))
    near = wide.join(other, ["source_id", "at"]).where(F.col("page_start").eqNullSafe(F.col("page2")) & ((F.col("section") == "") | (F.col("section2") == "") | (F.col("section") == F.col("section2"))))
    listed = near.groupBy("source_id", "item_id").agg(F.array_sort(F.collect_list(F.struct("at", "other_id", "text"))).alias("near"))  # at most 2 * reach
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<string>").alias("ids"), F.array().cast("array<string>").alias("parts"))

    def take(state, x):
        room = state["left"] > 0
        clipped = F.substring(x["text"], F.lit(1), state["left"])
        return F.struct(
            F.when(room, state["left"] - F.length(clipped)).otherwise(state["left"]).alias("left"),
            F.when(room, F.concat(state["ids"], F.array(x["other_id"]))).otherwise(state["ids"]).alias("ids"),
            F.when(room, F.concat(state["parts"], F.array(clipped))).otherwise(state["parts"]).alias("parts"),
        )

    folded = listed.select("source_id", "item_id", F.aggregate("near", start, take).alias("state"))
    return visuals.select("source_id", "item_id").join(folded, ["source_id", "item_id"], "left").select("source_id", "item_id", F.coalesce("state.ids", F.array().cast("array<string>")).alias("context_item_ids"), F.coalesce(F.array_join("state.parts", " "), F.lit("")).alias("context"))


def heading_paths(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, path: the stack of headings at each heading line of a Markdown text.

    ``lines``: doc_id, text. A heading of level n cuts the stack to its first n - 1 entries and is pushed; a blank heading
    only cuts. The stack is cut by place, so two level-3 headings without a parent give ``A > B``.
    """
    heads = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line"))), lambda x: x.line.rlike(r"^#{1,6}(\s|$)"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<n:int,path:string>>").alias("out"))

    def push(state, x):
        level = F.length(F.regexp_extract(x.line, r"^(#+)", 1))
        title = F.trim(F.regexp_replace(x.line, r"^#+", ""))
        cut = F.slice(state["stack"], F.lit(1), F.least(level - 1, F.size(state["stack"])))
        stack = F.when(title != "", F.concat(cut, F.array(title))).otherwise(cut)
        return F.struct(stack.alias("stack"), F.concat(state["out"], F.array(F.struct(x.n.alias("n"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    return lines.select("doc_id", F.inline(F.aggregate(heads, start, push, lambda s: s["out"]))).select("doc_id", F.col("n").alias("line_no"), "path")


def select_evidence(hits: DataFrame, placed: DataFrame, limit: int = 8, wide_limit: int = 12) -> DataFrame:
    """query_id, place, source_id, item_id, origin: the evidence for each query, in order.

    ``hits``: query_id, rank, source_id, item_ids, aggregating. Items of the hits come first in hit order, each short one
    followed by its neighbours; for aggregating questions the items of the same section follow. The first ``limit``
    (``wide_limit`` for aggregating questions) distinct items are kept: the cut is the feature.
    """
    direct = hits.select("query_id", "rank", "source_id", "aggregating", F.posexplode("item_ids").alias("at", "item_id")).join(placed.select("source_id", "item_id", "position", "page_start", empty(F.col("breadcrumb")).alias("section")), ["source_id", "item_id"])
    row = lambda origin, phase, minor: [F.col("query_id"), F.col("aggregating"), F.col("source_id"), F.lit(origin).alias("origin"), F.struct(F.lit(phase).alias("phase"), F.col("rank").alias("rank"), F.col("at").alias("at"), minor.cast("int").alias("minor")).alias("order")]
    a = direct.select(*row("hit", 0, F.lit(0)), "item_id")
    beside = direct.join(neighbours(placed), ["source_id", "item_id"])
    b = beside.select(*row("adjacent", 0, F.when(F.col("side") < 0, 1).otherwise(2)), F.col("neighbour_id").alias("item_id"))
    first = top_rows(placed.select("source_id", "page_start", empty(F.col("breadcrumb")).alias("section"), F.col("item_id").alias("sibling_id"), F.col("position").alias("place")), ["source_id", "page_start", "section"], ["place"], 3 * wide_limit, "n")
    wide = direct.where("aggregating").alias("d").join(first.alias("s"), (F.col("d.source_id") == F.col("s.source_id")) & F.col("d.page_start").eqNullSafe(F.col("s.page_start")) & (F.col("d.section") == F.col("s.section"))).select("d.*", "s.sibling_id", "s.place")
    c = wide.select(*row("same_page", 1, F.col("place")), F.col("sibling_id").alias("item_id"))
    every = a.unionByName(b).unionByName(c)
    once = every.groupBy("query_id", "aggregating", "source_id", "item_id").agg(F.min(F.struct("order", "origin")).alias("first"))
    ranked = top_rows(once, ["query_id"], [F.col("first.order"), "source_id", "item_id"], wide_limit, "place")
    return ranked.where(F.col("place") <= F.when(F.col("aggregating"), wide_limit).otherwise(limit)).select("query_id", "place", "source_id", "item_id", F.col("first.origin").alias("origin"))
