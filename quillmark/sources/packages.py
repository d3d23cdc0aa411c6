"""Source packages: directories with manifest.json, items.jsonl, chunks.jsonl and assets.json, as typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASSET = "struct<asset_id:string,path:string,media_type:string,mime_type:string,sha256:string,source_path:string>"
ITEM = (
    "item_id string, sequence string, type string, page_start string, page_end string, bbox string, breadcrumb string, content struct<raw_text:string,caption:string,search_text:string,"
    "table:struct<html:string,rows:array<array<string>>>,equation:struct<latex:string>>, assets string, provenance string, metadata string, quality struct<needs_review:boolean>, retrieval struct<searchable:boolean,exclude:boolean>"
)
CHUNK = "chunk_id string, item_ids array<string>, text string, breadcrumb string, modalities array<string>, asset_ids array<string>, page_refs array<int>"
MANIFEST = "schema_version string, package_id string, document struct<title:string,source:struct<filename:string,media_type:string>>, parser struct<name:string,version:string>"


def package_of(path: Column) -> Column:
    """The name of the directory that a file lies in."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def asset_ids(json: Column) -> Column:
    """Ids of an item's assets, given as strings or as objects, in order and once each; null elements are left out."""
    plain = F.from_json(json, "array<string>")
    return F.array_distinct(F.filter(F.transform(plain, lambda x: F.coalesce(F.get_json_object(x, "$.asset_id"), F.when(~x.startswith("{"), x))), lambda x: x.isNotNull()))


def typed_records(lines: DataFrame, record: str = "record") -> DataFrame:
    """JSONL records of items as typed columns beside the input's own; ``broken`` marks blank or malformed ones (all null).

    Unknown keys are ignored, numbers written as text are read, an integer that is none is null.
    """
    ok = F.try_parse_json(F.col(record)).isNotNull() & (F.trim(F.col(record)).startswith("{"))
    item = F.when(ok, F.from_json(F.col(record), ITEM)).alias("_item")
    whole = lambda c: F.expr(f"try_cast(_item.{c} as int)").alias(c)
    return lines.withColumn("_item", item).select(
        *[c for c in lines.columns if c != record], F.coalesce(~ok, F.lit(True)).alias("broken"),
        F.col("_item.item_id").alias("item_id"), whole("sequence"), F.coalesce("_item.type", F.lit("text")).alias("item_type"), whole("page_start"), whole("page_end"), F.col("_item.breadcrumb").alias("breadcrumb"),
        F.col("_item.content.raw_text").alias("raw_text"), F.col("_item.content.caption").alias("caption"), F.col("_item.content.search_text").alias("search_text"), asset_ids(F.col("_item.assets")).alias("asset_ids"),
        (F.coalesce("_item.retrieval.searchable", F.lit(True)) & ~F.coalesce("_item.retrieval.exclude", F.lit(False))).alias("searchable"),
    )


def read_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """package, line_no, record of JSONL files; blank lines are skipped but counted.

    Files are read in splits; lines are numbered within their split, which is bounded, and the lines of the splits before
    are added, so a file of any size stays spread.
    """
    from pyspark.sql import Window

    where = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.text(pattern, lineSep="\n").select(*where, F.monotonically_increasing_id().alias("at"), F.col("value").alias("record"))
    counts = lines.groupBy("path", "split").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("path", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = lines.withColumn("own", F.row_number().over(Window.partitionBy("path", "split").orderBy("at")))
    numbered = own.join(bases, ["path", "split"]).select(package_of(F.col("path")).alias("package"), (F.col("base") + F.col("own")).cast("int").alias("line_no"), "record")
    return numbered.where(F.trim("record") != "")


def read_packages(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """packages, items, chunks and assets of all package directories under ``root``."""
    manifest = spark.read.schema(MANIFEST).json(f"{root}/*/manifest.json", multiLine=True)
    packages = manifest.select("package_id", "schema_version", F.col("document.title").alias("title"), F.col("document.source.filename").alias("source_filename"), F.col("document.source.media_type").alias("source_media_type"), F.col("parser.name").alias("parser_name"), F.col("parser.version").alias("parser_version"), package_of(F.col("_metadata.file_path")).alias("package"))
    items = typed_records(read_lines(spark, f"{root}/*/items.jsonl"))
    lines = read_lines(spark, f"{root}/*/chunks.jsonl")
    chunks = lines.select("package", "line_no", F.from_json("record", CHUNK).alias("c")).select("package", "line_no", "c.*")
    once = {c: F.array_distinct(F.filter(c, lambda x: x.isNotNull())) for c in ("item_ids", "modalities", "asset_ids", "page_refs")}
    files = spark.read.text(f"{root}/*/assets.json", wholetext=True).select(package_of(F.col("_metadata.file_path")).alias("package"), "value")
    bare = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{ASSET}>")).otherwise(F.from_json("value", f"struct<assets:array<{ASSET}>>")["assets"])
    assets = files.select("package", F.inline(bare)).withColumn("media_type", F.coalesce("media_type", "mime_type")).drop("mime_type")
    return {"packages": packages, "items": items, "chunks": chunks.withColumns(once), "assets": assets}


def package_problems(tables: dict[str, DataFrame], schema_version: str) -> DataFrame:
    """package, rule, detail: everything that makes a package unfit; its manifest must name ``schema_version``."""
    p, i, c, a = (tables[t] for t in ("packages", "items", "chunks", "assets"))
    say = lambda df, rule, detail: df.select("package", F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))
    twice = lambda df, key: df.groupBy("package", key).count().where("count > 1")
    item_assets = i.select("package", F.explode("asset_ids").alias("id"))
    checks = [
        say(p.where(F.coalesce(F.col("schema_version") != schema_version, F.lit(True))), "schema_version", F.col("schema_version")),
        say(p.where(F.coalesce(F.col("package_id").rlike(r"[/\\@# ]") | (F.col("package_id") == ""), F.lit(True))), "package_id", F.col("package_id")),
        say(i.where("broken"), "broken_line", F.col("line_no")),
        say(twice(i.where("not broken"), "item_id"), "repeated_item", F.col("item_id")),
        say(twice(c, "chunk_id"), "repeated_chunk", F.col("chunk_id")),
        say(twice(a, "asset_id"), "repeated_asset", F.col("asset_id")),
        say(item_assets.join(a.select("package", F.col("asset_id").alias("id")), ["package", "id"], "left_anti"), "item_without_asset", F.col("id")),
        say(c.select("package", F.explode("item_ids").alias("id")).join(i.select("package", F.col("item_id").alias("id")), ["package", "id"], "left_anti"), "chunk_without_item", F.col("id")),
        say(c.select("package", F.explode("asset_ids").alias("id")).join(a.select("package", F.col("asset_id").alias("id")), ["package", "id"], "left_anti"), "chunk_without_asset", F.col("id")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out.distinct()


def merge_parts(packages: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """Items of page-split packages as items of one source per ``group``: merged_id, sequence, page_start, source_id, item_id.

    ``packages``: package_id and group; parts follow in the order of package_id. Pages, page numbers in item ids and
    sequences are shifted by what the earlier parts hold; only one row per part is ordered within a group. Page numbers in
    ids have four digits at least and are never cut.
    """
    from pyspark.sql import Window

    number = F.coalesce("sequence", F.lit(0))
    sizes = items.groupBy("source_id").agg(F.coalesce(F.max("page_start"), F.lit(0)).alias("pages"), F.max(number).alias("rows"))
    parts = packages.select(F.col("package_id").alias("source_id"), group).join(sizes, "source_id")
    before = Window.partitionBy(group).orderBy("source_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select("source_id", group, F.coalesce(F.sum("pages").over(before), F.lit(0)).cast("int").alias("page_shift"), F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("int").alias("row_shift"))
    joined = items.join(shifts, "source_id")
    page = F.regexp_extract("item_id", r"^item-p(\d+)-b(\d+)$", 1)
    block = F.regexp_extract("item_id", r"^item-p(\d+)-b(\d+)$", 2)
    own = F.when(page != "", F.concat(F.lit("item-p"), F.format_string("%04d", page.cast("int") + F.col("page_shift")), F.lit("-b"), block)).otherwise(F.col("item_id"))
    return joined.select(group, own.alias("merged_id"), (number + F.col("row_shift")).alias("sequence"), (F.col("page_start") + F.col("page_shift")).alias("page_start"), "source_id", "item_id")


def empty_items(spark: SparkSession) -> DataFrame:
    """An empty items table, for sources without any."""
    return spark.createDataFrame([], T.StructType().add("source_id", "string").add("item_id", "string").add("sequence", "int"))
