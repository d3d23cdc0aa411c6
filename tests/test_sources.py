"""Readers, writers and streams on files."""

import datetime
import io
import json
import zipfile

from pyspark.sql import functions as F

from quillmark.sources import blocks, documents, packages, sinks
from quillmark.streaming.ingest import stream_counts, stream_upsert


def package(root, name, items, chunks, assets, version="v-1"):
    d = root / name
    d.mkdir(parents=True)
    (d / "manifest.json").write_text(json.dumps({"schema_version": version, "package_id": name, "document": {"title": name, "source": {"filename": "f.pdf", "media_type": "application/pdf"}}, "parser": {"name": "p", "version": "1"}}, indent=1))
    (d / "items.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in items))
    (d / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    (d / "assets.json").write_text(json.dumps(assets))


def test_packages(spark, tmp_path):
    item = {"item_id": "i1", "sequence": 1, "type": "paragraph", "page_start": "3", "content": {"raw_text": "文字"}, "assets": [{"asset_id": "a1"}, "a1", "a2"], "retrieval": {"exclude": True}, "extra": {"x": 1}}
    package(tmp_path, "good", [item, "", {"item_id": "i2"}], [{"chunk_id": "c1", "item_ids": ["i1", "i1"], "asset_ids": ["a1"]}], [{"asset_id": "a1", "path": "assets/a.png", "mime_type": "image/png"}, {"asset_id": "a2", "path": "b"}])
    package(tmp_path, "bad", [{"item_id": "i1", "assets": ["zz"]}, "{broken", {"item_id": "i1"}], [{"chunk_id": "c1", "item_ids": ["nope"]}], {"assets": [{"asset_id": "a1", "path": "p", "media_type": "x/y"}]}, version="other")
    t = packages.read_packages(spark, str(tmp_path))
    rows = {(r.package, r.item_id): r for r in t["items"].collect()}
    first = rows["good", "i1"]
    assert (first.line_no, first.page_start, first.raw_text, first.asset_ids, first.searchable) == (1, 3, "文字", ["a1", "a2"], False)
    assert rows["good", "i2"].line_no == 3 and rows["good", "i2"].item_type == "text" and rows["good", "i2"].searchable
    assert {(r.package, r.asset_id, r.media_type) for r in t["assets"].collect()} == {("good", "a1", "image/png"), ("good", "a2", None), ("bad", "a1", "x/y")}
    assert t["chunks"].where("package = 'good'").first().item_ids == ["i1"]
    found = {(r.package, r.rule) for r in packages.package_problems(t, "v-1").collect()}
    assert found == {("bad", r) for r in ("schema_version", "broken_line", "repeated_item", "item_without_asset", "chunk_without_item")}


def test_merged_parts(spark):
    p = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", None)], "package_id string, part_of string")
    i = spark.createDataFrame([("a", "item-p0001-b0001", 1, 1), ("a", "item-p0002-b0001", 2, 2), ("b", "item-p0001-b0002", 1, 1), ("b", "odd", None, None), ("c", "item-p0001-b0001", 1, 1)], "source_id string, item_id string, sequence int, page_start int")
    rows = {(r.source_id, r.item_id): (r.merged_id, r.sequence, r.page_start) for r in packages.merge_parts(p, i, "part_of").collect()}
    assert rows["b", "item-p0001-b0002"] == ("item-p0003-b0002", 3, 3) and rows["b", "odd"] == ("odd", 2, None) and rows["c", "item-p0001-b0001"] == ("item-p0001-b0001", 1, 1)


def test_merged_parts_beyond_page_9999(spark):
    p = spark.createDataFrame([("a", "g"), ("b", "g")], "package_id string, part_of string")
    i = spark.createDataFrame([("a", "item-p12344-b0001", 1, 12344), ("b", "item-p0001-b0001", 1, 1), ("b", "item-p0002-b0001", 2, 2)], "source_id string, item_id string, sequence int, page_start int")
    rows = {(r.source_id, r.item_id): r.merged_id for r in packages.merge_parts(p, i, "part_of").collect()}
    assert rows == {("a", "item-p12344-b0001"): "item-p12344-b0001", ("b", "item-p0001-b0001"): "item-p12345-b0001", ("b", "item-p0002-b0001"): "item-p12346-b0001"}


def test_blocks(spark, tmp_path):
    v2 = [[{"type": "title", "content": {"title_content": [{"content": "Head"}], "level": 1}}, {"type": "text", "text": "Body"}, "no block"], {"page_idx": 4, "blocks": [{"type": "image", "img_path": "x.png", "image_caption": ["Cap"], "bbox": [0, 0, 1, 0.5]}]}]
    flat = [{"type": "text", "text": "T", "text_level": 2, "page_idx": 0}, {"type": "text", "text": "p", "page_idx": 0}, {"type": "table", "table_body": "<table><tr><td>1</td></tr></table>", "page_idx": 1}, {"type": "header", "text": "h", "page_idx": 1}]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one_content_list_v2.json").write_text(json.dumps(v2))
    (tmp_path / "d/one_content_list.json").write_text("[]")
    (tmp_path / "two_content_list.json").write_text(json.dumps({"pages": flat}))
    rows = blocks.items_of_blocks(blocks.blocks(blocks.read_block_lists(spark, str(tmp_path)))).orderBy("stem", "sequence").collect()
    got = [(r.stem.split("/")[-1], r.item_id, r.item_type, r.breadcrumb, r.raw_text, r.searchable) for r in rows]
    assert got == [
        ("one", "item-p0001-b0001", "title", "Head", "Head", True), ("one", "item-p0001-b0002", "paragraph", "Head", "Body", True), ("one", "item-p0005-b0001", "image", "Head", "Cap", True),
        ("two", "item-p0001-b0001", "title", "T", "T", True), ("two", "item-p0001-b0002", "paragraph", "T", "p", True), ("two", "item-p0002-b0001", "table", "T", "", True), ("two", "item-p0002-b0002", "page_header", "T", "h", False),
    ]
    assert [r.coordinate_system for r in rows][2] == "normalized_1" and rows[5].search_text == "T 1" and rows[2].raw_ref == "content_list_v2[1][0]"


def test_all_cells_of_tables_are_searched(spark, tmp_path):
    from quillmark.plans import ingest

    cells = [[f"r{i}c{j}" for j in range(14)] for i in range(14)]
    words = [c for row in cells for c in row]
    rows = [("s", "i", datetime.datetime(2024, 1, 1), "Head", None, None, cells)]
    spark.createDataFrame(rows, "source_id string, item_id string, ingested_at timestamp, breadcrumb string, raw_text string, caption string, table_rows array<array<string>>").write.parquet(str(tmp_path / "package_items.parquet"))
    assert ingest.search_texts(spark, str(tmp_path)).first().search_text.split(" ") == ["Head", *words]


def test_markdown_and_sheets(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.md").write_text("![alt](img/x.png) ![](http://h/y.png) ![z](../up.png) ![q](n.txt)")
    refs = documents.image_references(documents.read_markdown(spark, str(tmp_path / "w")))
    assert [(r.place, r.problem) for r in refs.orderBy("place").collect()] == [(1, None), (2, "not local"), (3, "outside"), (4, "no image")]
    files = spark.createDataFrame([("img/x.png", bytearray(b"data"))], "target string, content binary")
    captions = spark.createDataFrame([], "sha256 string, caption string")
    row = documents.images_with_captions(refs, files, captions).first()
    assert row.status == "original text" and row.asset_id.startswith("asset-") and len(row.asset_id) == 26
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "s.xlsx").write_bytes(buffer.getvalue())
    (tmp_path / "t.xlsx").write_bytes(b"no workbook")
    assert [(r.row, r.cells) for r in documents.read_sheets(spark, str(tmp_path / "*.xlsx")).orderBy("row").collect()] == [(1, ["id", "", "x"]), (2, ["", "TRUE"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    path = str(tmp_path / "t")
    assert sinks.write_if_changed(df, path) and not sinks.write_if_changed(df.orderBy(F.desc("k")), path) and sinks.write_if_changed(df.limit(1), path)
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.replace_partitions(df, str(tmp_path / "part"), ["p"])
    sinks.replace_partitions(spark.createDataFrame([(9, "b")], "k int, p string"), str(tmp_path / "part"), ["p"])
    assert {(r.k, r.p) for r in spark.read.parquet(str(tmp_path / "part")).collect()} == {(1, "a"), (9, "b")}
    assert sinks.read_or_empty(spark, str(tmp_path / "none"), "k int") is None


def test_stream_keeps_the_earliest(spark, tmp_path):
    rows = [("s", "a", "late", "2024-01-03"), ("s", "a", "first", "2024-01-01"), ("s", "b", None, "2024-01-02")]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "source_id string, chunk_id string, text string, at string").selectExpr("source_id", "chunk_id", "text", "cast(at as timestamp) as ingested_at").write.mode("append").parquet(str(tmp_path / "in"))
    got = stream_upsert(spark, str(tmp_path / "in"), ["source_id", "chunk_id"], ["text"], files_per_batch=1)
    assert {(r.chunk_id, r.text) for r in got.collect()} == {("a", "first"), ("b", None)}


def test_stream_counts_every_row(spark, tmp_path):
    days = [30, 1, 2, 29, 3, 30, 1, 15, 2, 28]  # files out of order of time, several batches
    for n, day in enumerate(days):
        spark.createDataFrame([(f"2024-01-{day:02d} 10:00:00", "a" if n % 2 else None)] * 2, "at string, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = stream_counts(spark, str(tmp_path / "in"), "at", "kind")
    plain = spark.read.parquet(str(tmp_path / "in")).groupBy(F.col("at").substr(1, 10).alias("day"), "kind").count()
    assert sorted(map(repr, got.selectExpr("cast(cast(start as date) as string) as day", "kind", "n as count").collect())) == sorted(map(repr, plain.collect()))
    assert got.agg(F.sum("n")).first()[0] == 2 * len(days)


def test_first_sheet_is_the_workbooks_own():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" r:id="rId9"/><sheet name="A" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Target="worksheets/sheet2.xml"/></Relationships>')
        for n, text in ((1, "other"), (2, "own")):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"/><row r="3"><c r="AB3"><v> {text} </v></c></row></sheetData></worksheet>')
    rows = documents.sheet_rows(buffer.getvalue())
    assert rows == [[""] * 27 + ["own"]]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "p").mkdir()
    lines = ["" if n % 7 == 3 else f"line {n} " + "x" * (n % 50) for n in range(1, 3001)]
    (tmp_path / "p/items.jsonl").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.line_no: r.record for r in packages.read_lines(spark, str(tmp_path / "*/items.jsonl")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {n: t for n, t in enumerate(lines, 1) if t}


def test_nested_text_at_any_depth():
    value = '"end"'
    for n in range(300):
        value = f'[{value}]' if n % 2 else '{"children": ' + value + "}"
    assert blocks.leaf_text(value) == "end"
    assert blocks.leaf_text('[{"content": "a "}, "b", {"children": [{"content": "c"}, {"x": 1}]}, null, 3]') == "abc"
    assert blocks.leaf_text(" plain ") == "plain" and blocks.leaf_text(None) == "" and blocks.leaf_text("[broken") == "[broken"
