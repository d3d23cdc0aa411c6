"""Markdown trees and spreadsheets as rows."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
SUFFIXES = r"(?i)\.(png|jpe?g|gif|webp|bmp|svg|tiff?)$"


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """path, text of all Markdown files under ``root``."""
    return spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def image_references(pages: DataFrame) -> DataFrame:
    """path, place, alt, target, problem: image links of Markdown pages; problem is null for safe local images."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(IMAGE), F.lit(1)).alias("alt"), F.regexp_extract_all("text", F.lit(IMAGE), F.lit(2)).alias("target"))
    each = pages.select("path", F.posexplode(both).alias("n", "x")).select("path", (F.col("n") + 1).alias("place"), "x.alt", "x.target")
    t = F.col("target")
    problem = F.when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "not local").when(t.startswith("/"), "absolute").when(t.rlike(r"(^|/)\.\.(/|$)"), "outside").when(~t.rlike(SUFFIXES), "no image")
    return each.withColumn("problem", problem)


def images_with_captions(references: DataFrame, files: DataFrame, captions: DataFrame) -> DataFrame:
    """path, place, asset_id, alt, status: references joined with files (target, content) and captions (sha256, caption).

    Equal bytes are one asset, named by their hash; the caption of the bytes replaces the alternative text.
    """
    hashed = files.select("target", F.sha2("content", 256).alias("sha256"))
    joined = references.where("problem is null").join(hashed, "target", "left").join(captions, "sha256", "left")
    caption = F.nullif(F.trim("caption"), F.lit(""))
    status = F.when(F.col("sha256").isNull(), "file missing").when(caption.isNotNull(), "ready").when(F.col("alt") != "", "original text").otherwise("caption missing")
    return joined.select("path", "place", F.concat(F.lit("asset-"), F.substring("sha256", 1, 20)).alias("asset_id"), F.coalesce(caption, "alt").alias("alt"), status.alias("status"))


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part of a workbook that holds the sheet its own list names first; without a list, the one of the least number."""
    if "xl/workbook.xml" not in book.namelist():
        return min((n for n in book.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    sheet = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//{*}sheet"))
    relation = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iterfind(".//{*}Relationship")}
    return posixpath.normpath(posixpath.join("/xl", targets[relation])).lstrip("/")


def place_of(reference: str) -> tuple[int, int]:
    """(row, column), both from 1, of a reference such as AB12."""
    letters = reference.rstrip("0123456789")
    column = sum((ord(c) - 64) * 26**n for n, c in enumerate(reversed(letters)))
    return int(reference[len(letters) :]), column


def sheet_rows(content: bytes) -> list[list[str]]:
    """The cells of the first sheet of a workbook, as text; rows without cells are left out."""
    spoken = lambda e: "".join(t.text or "" for t in e.iterfind(".//{*}t"))
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = [spoken(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iterfind(".//{*}si")] if "xl/sharedStrings.xml" in book.namelist() else []
        cells = list(ElementTree.fromstring(book.read(first_sheet(book))).iterfind(".//{*}c"))
    read = {"s": lambda c, v: strings[int(v)] if v else "", "b": lambda c, v: str(v == "1").upper(), "inlineStr": lambda c, v: spoken(c)}
    table = pd.DataFrame([(*place_of(c.get("r")), read.get(c.get("t"), lambda c, v: v)(c, c.findtext("{*}v", "")).strip()) for c in cells], columns=["row", "column", "text"])
    return [own.set_index("column")["text"].reindex(range(1, own["column"].max() + 1), fill_value="").tolist() for _, own in table.groupby("row")]


def read_sheets(spark: SparkSession, pattern: str) -> DataFrame:
    """path, row, cells of the first sheets of workbooks; a file that is no workbook has no rows. One file per task step."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    out += [(path, n, cells) for n, cells in enumerate(sheet_rows(content), 1)]
                except (zipfile.BadZipFile, KeyError, IndexError, StopIteration, ValueError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["path", "row", "cells"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, row int, cells array<string>")
