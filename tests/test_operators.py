"""Operators without SQL, and edge cases of those with it, on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmark.functions import answers, wiki
from quillmark.functions import text as tx
from quillmark.functions import vectors as vx
from quillmark.functions.models import embedder, fill_cache, rerank
from quillmark.operators import bm25, context, fusion, graph, index, integrity, nearest, pages
from quillmark.operators.order import positions, running_sum


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_tokens_and_labels(spark):
    assert one(spark, tx.tokens(F.col("t")), t="Ab-c D.1 检测系统X图 单") == ["ab-c", "d.1", "x", "检测", "测系", "系统", "图", "单"]
    assert one(spark, tx.tokens(F.col("t")), t=None) == []
    assert one(spark, tx.labels(F.col("t")), t="see Figure 2 and figure 2, 图 3") == ["figure 2", "图 3"]
    assert one(spark, tx.slug(F.col("t")), t="  A b/ü*! ") == "A-b-ü"
    assert one(spark, tx.excerpt(F.col("t"), F.col("q"), limit=30), t="x" * 50 + " needle " + "y" * 50, q=["needle"]).startswith("…")
    assert one(spark, tx.number_citations(F.col("t"), F.col("q")), t="p [s#1] q [s#12]", q=["s#1", "s#12"]) == "p 〔1〕 q 〔2〕"
    assert one(spark, tx.wiki_links(F.col("t")), t="[[a.md#x|y]] ![[img]] [[b]]") == ["a", "b"]


def test_positions_against_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([None, 0, 700, 1500]), i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, s int, i int")
    got = {r.i: r.position for r in positions(df, ["g"], context.stretch(F.col("s")), [F.coalesce("s", F.lit(0)), "i"]).collect()}
    want = {}
    for g in "ab":
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] or 0, x[2]))
        want |= {x[2]: n for n, x in enumerate(own, 1)}
    assert got == want
    assert running_sum(df.where("false"), ["g"], F.col("s"), ["i"], F.lit(1), "n").count() == 0


def test_bm25_against_python(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(f"d{i:02d}", [rng.choice(words) for _ in range(rng.randrange(0, 9))]) for i in range(40)]
    queries = [(f"q{i}", [rng.choice([*words, "none"]) for _ in range(3)]) for i in range(5)]
    none = ["cast(array() as array<string>) as labels", "false as visual", "false as tabular"]
    d = spark.createDataFrame(docs, "doc_key string, tokens array<string>").selectExpr("*", *none, "0.0D as extra")
    q = spark.createDataFrame(queries, "query_id string, tokens array<string>").selectExpr("*", *none)
    got = {(r.query_id, r["rank"]): (r.doc_key, r.score) for r in bm25.rank_documents(q, d, 4).collect()}
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    for name, asked in queries:
        scores = []
        for key, t in docs:
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / max(mean, 1))) for w in set(asked) if tf[w])
            if s > 0:
                scores.append((-round(s, 6), key))
        for rank, (s, key) in enumerate(sorted(scores)[:4], 1):
            assert got[name, rank] == (key, -s)
    assert bm25.rank_documents(q, d.where("false"), 4).count() == 0
    assert bm25.rank_documents(q.where("false"), d, 4).count() == 0


def test_nearest_against_numpy_and_edge_cases(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(50, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(90, None), (91, []), (92, [0.0] * 6), (93, [1.0])]
    v = spark.createDataFrame(rows, "vec_id int, vector array<double>")
    q = v.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in nearest.nearest(q, v, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for i in range(0, 50, 10):
        s = (unit @ unit[i]).round(6)
        want = [j for j in sorted(range(50), key=lambda j: (-s[j], j)) if j != i][:5]
        assert [j for _, j in sorted(got[i])] == want
    assert set(got) == {0, 10, 20, 30, 40}
    assert nearest.nearest(q.where("false"), v, 5).count() == 0


def test_cosine_and_embedding(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r.x, 6) for r in df.select(vx.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [0.707107, 0.0, 0.0, 0.0]
    import hashlib

    assert one(spark, vx.hash_embedding(F.col("t")), t="abc") == [round(b / 255, 6) for b in hashlib.sha256(b"abc").digest()]


def test_fusion_ties(spark):
    a = spark.createDataFrame([("q", 1, "x"), ("q", 2, "y")], "query_id string, rank int, key string")
    b = spark.createDataFrame([("q", 1, "y"), ("q", 2, "x")], "query_id string, rank int, key string")
    rows = fusion.fuse({"a": a, "b": b}, "key", 5).collect()
    assert [(r["rank"], r.key, r.channels) for r in rows] == [(1, "x", ["a", "b"]), (2, "y", ["a", "b"])]


ITEM = "source_id string, item_id string, sequence int, item_type string, page_start int, breadcrumb string, raw_text string, caption string, search_text string"


def test_context_of_visuals_and_neighbours(spark):
    rows = [("s", f"i{n}", n, t, p, b, x, None, None) for n, t, p, b, x in [
        (1, "paragraph", 1, "A", "one"), (2, "image", 1, "A", ""), (3, "paragraph", 1, "A", "three"), (4, "title", 1, "A", "head"), (5, "paragraph", 1, "B", "other"), (6, "paragraph", 2, "A", "next page"), (7, "image", None, None, None),
    ]]
    placed = context.placed_items(spark.createDataFrame(rows, ITEM))
    seen = {r.item_id: (r.context_item_ids, r.context) for r in context.visual_context(placed).collect()}
    assert seen == {"i2": (["i1", "i3"], "one three"), "i7": ([], "")}
    assert context.visual_context(placed, budget=5).where("item_id = 'i2'").first().context == "one th"
    near = {(r.item_id, r.neighbour_id, r.side) for r in context.neighbours(placed).collect()}
    assert ("i2", "i1", -1) in near and ("i2", "i3", 1) in near and ("i4", "i5", 1) not in near and ("i5", "i6", 1) not in near
    assert context.visual_context(placed.where("false")).count() == 0


def test_selected_evidence(spark):
    rows = [("s", f"i{n:02d}", n, "paragraph", 1, "A", "x" * (100 if n == 5 else 10), None, None) for n in range(1, 20)]
    placed = context.placed_items(spark.createDataFrame(rows, ITEM))
    hits = spark.createDataFrame([("q1", 1, "s", ["i05", "i09"], False), ("q2", 1, "s", ["i05"], True)], "query_id string, rank int, source_id string, item_ids array<string>, aggregating boolean")
    got = {}
    for r in context.select_evidence(hits, placed).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.item_id, r.origin))
    assert got["q1"] == [("i05", "hit"), ("i09", "hit"), ("i08", "adjacent"), ("i10", "adjacent")]
    assert [i for i, _ in got["q2"]] == ["i05", "i01", "i02", "i03", "i04", "i06", "i07", "i08", "i09", "i10", "i11", "i12"]


def test_heading_paths(spark):
    df = spark.createDataFrame([(1, "# A\ntext\n### B\n### C\n## D\n#\nend"), (2, None), (3, "")], "doc_id int, text string")
    assert [(r.doc_id, r.line_no, r.path) for r in context.heading_paths(df).orderBy("doc_id", "line_no").collect()] == [(1, 1, "A"), (1, 3, "A > B"), (1, 4, "A > B > C"), (1, 5, "A > D"), (1, 6, "")]


def test_graph_policies(spark):
    docs = spark.createDataFrame([(1, "w/a.md", "A", "x", "[[b]] [[Dup]] [[gone]] [[a]]"), (2, "w/b.md", "Dup", "x", "[[w/a]]"), (3, "w/c.md", "Dup", "x", None), (4, None, "z", "x", "[[a]]"), (5, "w/a.md", "late copy", "x", "[[b]]")], "doc_id int, path string, title string, kind string, text string")
    nodes = graph.nodes(docs)
    names = graph.aliases(nodes)
    strict = {(r.source, r.link): r.target for r in graph.links(nodes, names).collect()}
    assert strict == {("w/a.md", "b"): "w/b.md", ("w/a.md", "Dup"): None, ("w/a.md", "gone"): None, ("w/a.md", "a"): "w/a.md", ("w/b.md", "w/a"): "w/a.md"}
    assert {r.target for r in graph.links(nodes, names, strict=False).where("link = 'Dup'").collect()} == {"w/b.md"}
    values = {r.measure: r.value for r in graph.health(nodes, names, graph.links(nodes, names)).collect()}
    assert values == {"nodes": 3, "edges": 2, "orphans": 1, "wanted": 2, "ambiguous_names": 1, "duplicate_titles": 1}


def test_index_update(spark):
    now = spark.createDataFrame([("s", "a", "t1", "v1", "h1"), ("s", "b", "t2", "v1", "h2"), ("t", "c", "t3", None, "h3")], "source_id string, chunk_id string, text string, source_version string, content_hash string")
    old = spark.createDataFrame([("s", "a", "v1", "h1", [9.0]), ("s", "b", "v1", "old", [9.0]), ("s", "gone", "v1", "h", [9.0])], "source_id string, chunk_id string, source_version string, content_hash string, vector array<double>")
    assert {(r.chunk_id, r.action) for r in index.plan_update(old, now).collect()} == {("a", "reuse"), ("b", "embed"), ("c", "embed"), ("gone", "drop")}
    new = {r.chunk_id: r for r in index.update_index(old, now).collect()}
    assert new["a"].vector == [9.0] and new["a"].reused and not new["b"].reused and len(new["c"].vector) == 32
    assert index.index_status(now.withColumn("vector", F.lit(None)), now).first().fresh is True
    a = spark.createDataFrame([("s", "a", ["x"], "t")], "source_id string, chunk_id string, asset_ids array<string>, text string")
    assets = spark.createDataFrame([], "source_id string, asset_id string, sha256 string, vault_path string")
    assert index.chunk_fingerprints(a, assets).first().fingerprint == index.chunk_fingerprints(a.repartition(3), assets).first().fingerprint


def test_pages(spark):
    schema = "path string, title string, source_ids array<string>, content_hash string"
    old = spark.createDataFrame([("p", "T", ["a"], "h"), ("q", "U", ["a"], "h")], schema).withColumn("revision", F.lit(3))
    new = spark.createDataFrame([("p", "T2", ["b", "a"], "h2"), ("r", "V", None, "h")], schema)
    got = {r.path: (r.title, r.source_ids, r.revision, r.changed) for r in pages.upsert_pages(old, new).collect()}
    assert got == {"p": ("T2", ["a", "b"], 4, True), "q": ("U", ["a"], 3, False), "r": ("V", [], 1, True)}
    keep = spark.createDataFrame([("a",)], "source_id string")
    cases = spark.createDataFrame([("k", ["a"]), ("m", ["a", "b"]), ("d", ["b"]), ("n", [])], "path string, source_ids array<string>")
    assert {r.path: r.action for r in pages.curated_pages(cases, keep).collect()} == {"k": "keep", "m": "mixed", "d": "drop", "n": "keep"}
    text = "---\nx: 1\n---\n# T\n\nBody [[s@v#i]]\n\n## Evidence\nrest"
    assert one(spark, wiki.clean_page(F.col("t"), F.lit("T")), t=text) == "Body `s@v#i`"
    assert one(spark, wiki.path_problem(F.col("t")), t="a/../b") == "outside" and one(spark, wiki.path_problem(F.col("t")), t="a/b.png") is None


def test_integrity(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert {(r.k, r.side) for r in integrity.set_difference(a.where("k is not null"), b, ["k"]).collect()} == {(1, "missing"), (3, "extra")}
    assert integrity.missing_parents(a, b, {"k": "k"}, "x").first().asDict() == {"check": "x", "rows": 1, "distinct_keys": 1}
    assert integrity.coverage(a.where("false"), b, "k").first().rate == 1.0


def test_answers():
    assert answers.plain_answer("  ＡＢ，c。 ") == "abc" and answers.plain_answer(None) == ""
    assert answers.math_delimiters(r"cost $5 and $x^2$ `$y$` \[ a \]") == "cost $5 and \\(x^2\\) `$y$` \n$$\na\n$$\n"
    assert answers.lenient_json('text {"a": 1} more') == '{"a": 1}' and answers.lenient_json('```json\n{"b": 2}\n```') == '{"b": 2}' and answers.lenient_json("no") is None


def test_models(spark):
    df = spark.createDataFrame([("a",), (None,), ("bb",)], "t string")
    assert [r.v for r in df.select(embedder(lambda texts: [[float(len(t))] for t in texts])("t").alias("v")).collect()] == [[1.0], None, [2.0]]
    c = spark.createDataFrame([("q", "x", "d1", "aaa"), ("q", "x", "d2", "a"), ("q", "x", "d3", "aaa")], "query_id string, query string, doc_key string, text string")
    assert [(r["rank"], r.doc_key) for r in rerank(c, lambda q, t: [len(x) for x in t], 2).orderBy("rank").collect()] == [(1, "d1"), (2, "d3")]
    wanted = spark.createDataFrame([("k1", "in"), ("k2", "in2"), ("k2", "in2")], "key string, input string")
    cache = spark.createDataFrame([("k1", "cached", "ready"), ("k2", "broken", "error")], "key string, text string, status string")
    assert {(r.key, r.text, r.status) for r in fill_cache(wanted, cache, "key", lambda xs: [x.upper() for x in xs]).collect()} == {("k1", "cached", "ready"), ("k2", "IN2", "ready")}


def test_clean_page_and_answers(spark):
    from quillmark.functions import answers, wiki

    fronts = "".join(f"---\nkey: {n}\n---\n" for n in range(6))
    df = spark.createDataFrame([(fronts + "\n# Title\n\nbody [[s@v#i]]\n## Evidence\nx", "Title"), ("a\n---\nin the middle\n---\nb", None), (None, "T")], "text string, title string")
    assert [r[0] for r in df.select(wiki.clean_page(F.col("text"), F.col("title"))).collect()] == ["body `s@v#i`", "a\nb", ""]
    math = r"cost $5 and $6, formula $x_1$ \[ a+b \] `code $x$` \( y \) $$ z $$ and $a = b$ $"
    assert answers.math_delimiters(math) == "cost $5 and $6, formula \\(x_1\\) \n$$\na+b\n$$\n `code $x$` \\(y\\) \n$$\nz\n$$\n and \\(a = b\\) $"
    cases = {'pre ```json\n{"a": {"b": "}"}}\n``` post': '{"a": {"b": "}"}}', '"{\\"a\\":1}"': '{"a": 1}', "[1]": None, '{"a":1,} then {"b":2}': '{"b": 2}', None: None, '[{"a": 1}]': '{"a": 1}', "{": None}
    assert {k: answers.lenient_json(k) for k in cases} == cases


def test_fingerprints_tell_sets_of_rows(spark):
    from quillmark.operators import index

    rows = [("s", f"r{n}") for n in range(300)] + [("t", "r1")]
    prints = lambda rs: {r.k: (r.records, r.fingerprint) for r in index.fingerprints(spark.createDataFrame(rs, "k string, json string"), ["k"]).collect()}
    a = prints(rows)
    assert a == prints(rows[::-1]) and a["s"] != a["t"] and len(a["s"][1]) == 64
    assert prints(rows[1:])["s"] != a["s"] and prints([*rows, rows[0]])["s"] != a["s"] and prints([*rows, rows[0]])["t"] == a["t"]


def test_curated_by_title_is_curated_pages(spark):
    from quillmark.operators import pages

    docs = [("p1", "A", "s1"), ("p2", "A", "s2"), ("p3", "B", "s1"), ("p4", None, "s1"), ("p5", None, "s2"), ("p6", "C", None), ("p7", None, None), ("p8", "D", "s3"), ("p9", "A", None)]
    df = spark.createDataFrame(docs, "path string, title string, package_id string")
    keep = spark.createDataFrame([("s1",)], "source_id string")
    titles = {}
    for _, t, p in docs:
        if t and p:
            titles.setdefault(t, set()).add(p)
    whole = spark.createDataFrame([(path, sorted(titles.get(t, set()) | ({p} if p else set()))) for path, t, p in docs], "path string, source_ids array<string>")
    assert set(pages.curated_by_title(df, df, keep).collect()) == set(pages.curated_pages(whole, keep).collect())


def test_bm25_blocks_and_batches_agree(spark, monkeypatch):
    import random

    from quillmark.operators import bm25

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{n:03}", [rng.choice(words) for _ in range(rng.randrange(0, 30))], rng.sample(["fig 1", "table 2"], rng.randrange(2)), rng.random() < 0.3, False, rng.choice([0.0, 0.1])) for n in range(200)]
    d = spark.createDataFrame(docs + docs[:0], "doc_key string, tokens array<string>, labels array<string>, visual boolean, tabular boolean, extra double").repartition(3)
    q = spark.createDataFrame([(f"q{n}", [rng.choice(words) for _ in range(3)] if n else [], ["fig 1"] if n % 3 == 0 else [], n % 2 == 0, False) for n in range(12)], "query_id string, tokens array<string>, labels array<string>, visual boolean, tabular boolean")
    get = lambda: sorted(map(tuple, bm25.rank_documents(q, d, 5).collect()))
    whole = get()
    monkeypatch.setattr(bm25, "BLOCK", 5)
    monkeypatch.setattr(bm25, "BATCH", 7)
    assert get() == whole and len(whole) == 60
    assert bm25.rank_documents(q, d.where("false"), 5).count() == 0 and bm25.rank_documents(q.where("false"), d, 5).count() == 0


def test_citing(spark):
    from quillmark.operators import citing

    cases = spark.createDataFrame([("q1", "s", ["i1", "i2", None, ""], ["a.md", "b.md", None]), ("q2", None, ["i1"], ["a.md"]), ("q3", "t", None, ["a.md"])], "id string, source_id string, evidence_item_ids array<string>, wiki_page_paths array<string>")
    evidence = citing.page_evidence(cases)
    assert {tuple(r) for r in evidence.collect()} == {(p, "s", i) for p in ("a.md", "b.md") for i in ("i1", "i2")}
    pages = spark.createDataFrame([("a.md", "Z", "entity", "x"), ("b.md", "A", "concept", None), ("c.md", "C", "entity", "s")], "path string, title string, kind string, package_id string")
    own = citing.supporting_pages(evidence, pages)
    assert {(r.item_id, r.path) for r in own.collect()} == {(i, p) for p in ("a.md", "b.md") for i in ("i1", "i2")}
    packages = spark.createDataFrame([("s", "Source")], "package_id string, title string")
    assert {tuple(r) for r in citing.evidence_titles(evidence, own, packages).collect()} == {("s", i, "Z", "a.md") for i in ("i1", "i2")}
    assert {r.title for r in citing.evidence_titles(evidence, own.where("false"), packages).collect()} == {"Source"}
    selected = spark.createDataFrame([("q1", 1, "s", "i1"), ("q1", 2, "s", "i9")], "query_id string, place int, source_id string, item_id string")
    hits = spark.createDataFrame([("q1", 2, "s#c2", 1.0, "s", ["i1"]), ("q1", 1, "s#c1", 2.0, "s", ["i1", "i1", None]), ("q1", 1, "t#c1", 3.0, "t", ["i9"])], "query_id string, rank int, doc_key string, score double, source_id string, item_ids array<string>")
    assert {tuple(r) for r in citing.cited_hits(selected, hits).collect()} == {("q1", 1, "s", "i1", 1, "s#c1", 2.0, "bm25"), ("q1", 2, "s", "i9", None, "adjacent-context-i9", 0.0, "adjacent_context")}
    answers = spark.createDataFrame([("q", "x [b] y [a] [b]", ["c", "a", "b", "d"]), ("n", None, ["z"])], "query_id string, answer string, citations array<string>")
    assert sorted(map(tuple, citing.citation_order(answers).collect())) == [("n", 1, "z"), ("q", 1, "b"), ("q", 2, "a"), ("q", 3, "c"), ("q", 4, "d")]
    actions = spark.createDataFrame([(1, "A b", "k", "create", "r1"), (2, " a B ", "k", "update", "r2"), (3, "A b", "k", "create", "r1"), (4, "A b", None, "create", None), (5, None, "k", "create", "x")], "n int, title string, kind string, action string, reason string")
    assert {tuple(r) for r in citing.merged_actions(actions).collect()} == {("A b", "k", "update", "r1；r2"), ("A b", None, "create", "")}
    assert [r.path for r in citing.matching_pages(pages, spark.createDataFrame([(" z", "entity"), ("A", "entity")], "title string, kind string")).collect()] == ["a.md"]
    assets = spark.createDataFrame([("s", "c2")], "source_id string, chunk_id string")
    assert tuple(citing.first_with_asset(hits, assets).first()) == ("q1", 2, "s#c2", True)


def test_stages(spark):
    from quillmark.operators import stages

    schema = "source_id string, source_version string, text_signature string, visual_signature string"
    old = spark.createDataFrame([("same", "1", "t", "v"), ("version", "1", "t", "v"), ("signature", "1", "t", None), ("visual", "1", "t", "v"), ("gone", "1", "t", "v"), ("unbuilt", "1", "t", None), ("null", None, "t", "v")], schema)
    new = spark.createDataFrame([("same", "1", "t", "v"), ("version", "2", "t", "v"), ("signature", "1", "u", "v"), ("visual", "1", "t", "w"), ("unbuilt", "1", "t", "v"), ("new", "1", "t", "v"), ("null", None, "t", "v")], schema)
    got = {r.source_id: (r.text_action, r.visual_action) for r in stages.stage_plan(old, new).collect()}
    assert got == {"same": ("keep", "keep"), "version": ("build", "drop"), "signature": ("build", "wait"), "visual": ("keep", "build"), "gone": ("drop", "drop"), "unbuilt": ("keep", "build"), "new": ("build", "wait"), "null": ("keep", "keep")}
    assert [r.source_id for r in stages.changed_sources(old, new, spark.createDataFrame([("x",)], "source_id string")).collect()] == ["version"]
    packages = spark.createDataFrame([("s", "1"), ("t", None)], "package_id string, source_version string")
    assets = spark.createDataFrame([("s", "a", " AB ", "p", None), ("t", "a", "ab", None, "w"), ("s", "b", "cd", "p", "v"), ("s", "n", None, "p", "v")], "source_id string, asset_id string, sha256 string, path string, vault_path string")
    derived = spark.createDataFrame([("s", "a", True), ("t", "a", True), ("t", "a", True), ("s", "b", False), ("s", "n", True)], "source_id string, asset_id string, searchable boolean")
    now = stages.visual_records(assets, derived, packages)
    assert {(r.source_id, r.asset_id, r.path, r.sha256) for r in now.collect()} == {("s", "a", "p", "ab"), ("t", "a", "w", "ab")}
    first = stages.update_visual_index(now.where("false").withColumn("vector", F.array(F.lit(0.0))), now)
    assert len({tuple(r.vector) for r in first.collect()}) == 1 and not any(r.reused for r in first.collect())
    stored = now.where("source_id = 't'").withColumn("vector", F.array(F.lit(0.5)))
    assert {(r.source_id, r.reused, len(r.vector)) for r in stages.update_visual_index(stored, now).collect()} == {("s", False, 32), ("t", True, 1)}
    records = stages.page_records(spark.createDataFrame([("a", "T", "x"), ("b", None, None)], "path string, title string, text string"))
    again = stages.update_page_index(records.where("path = 'a'").withColumn("vector", F.array(F.lit(0.5))), records)
    assert {(r.path, r.reused, len(r.vector)) for r in again.collect()} == {("a", True, 1), ("b", False, 32)}


def test_navigation_and_answers(spark):
    from quillmark.operators import evaluation

    cases = spark.createDataFrame([("q1", "s", ["p9", None]), ("q2", "t", None), ("q3", None, None)], "id string, source_id string, wiki_page_paths array<string>")
    pages_ = spark.createDataFrame([("q1", 1, "p1", "x"), ("q1", 2, "p2", "s"), ("q1", 3, "p9", "s"), ("q2", 4, "p2", "t")], "query_id string, rank int, path string, source_id string")
    sources = spark.createDataFrame([("q2", 2, "t"), ("q1", 1, "x")], "query_id string, rank int, source_id string")
    assert {tuple(r) for r in evaluation.navigation_ranks(cases, pages_, sources).collect()} == {("q1", None, 2, 3, 2), ("q2", 2, 4, None, 2), ("q3", None, None, None, None)}
    answers = spark.createDataFrame([("ab", "Evidence ID 〔1〕 xxxxxx", False, False), (None, None, True, False)], "expected string, found string, exact boolean, contained boolean")
    row = evaluation.baseline_summary(answers).first()
    assert (row.cases, row.exact, row.contained, row.with_evidence_id, row.with_marker, row.over_3x) == (2, 1, 0, 1, 1, 1)
    rows = spark.createDataFrame([("a", True, True, 0.5, True), ("a", False, True, None, False), ("b", None, False, 1.0, False)], "g string, answerable boolean, covered boolean, keywords double, cited boolean")
    assert {tuple(r) for r in evaluation.answer_metrics(rows, F.col("g")).collect()} == {("a", 2, 0.5, 1.0, 0.5, 0.5), ("b", 1, 0.0, None, 1.0, 0.0)}


def test_nudges_lift_documents_of_a_source(spark):
    d = spark.createDataFrame([("s#1", "s", ["a"]), ("t#1", "t", ["a"]), ("t#2", "t", ["z"])], "doc_key string, source_id string, tokens array<string>").selectExpr("*", "array() as labels", "false as visual", "false as tabular", "0.0D as extra").withColumn("labels", F.array().cast("array<string>"))
    q = spark.createDataFrame([("q", ["a"])], "query_id string, tokens array<string>").selectExpr("*", "false as visual", "false as tabular").withColumn("labels", F.array().cast("array<string>"))
    nudges = spark.createDataFrame([("q", "t", 0.001)], "query_id string, source_id string, nudge double")
    assert [r.doc_key for r in bm25.rank_documents(q, d, 5).orderBy("rank").collect()] == ["s#1", "t#1"]
    got = bm25.rank_documents(q, d, 5, nudges).orderBy("rank").collect()
    assert [r.doc_key for r in got] == ["t#1", "s#1", "t#2"] and got[2].score == 0.001


def test_positions_without_sequences(spark):
    rows = [("s", f"item-{n:07}-x", None, n) for n in range(300)] + [("s", f"late-{n}", n + 1, n) for n in range(700)] + [("s", "item-0", -3, 0), ("s", "zero", 0, 0), (None, "a", None, 0)]
    df = spark.createDataFrame(rows, "source_id string, item_id string, sequence int, extra int")
    got = {(r.source_id, r.item_id): r.position for r in context.placed_items(df).collect()}
    want = sorted((r for r in rows if r[0]), key=lambda r: (r[2] or 0, r[1]))
    assert [got["s", r[1]] for r in want] == list(range(1, len(want) + 1)) and got[None, "a"] == 1
    assert df.select(context.part_of_order(F.col("sequence"), F.col("item_id"))).distinct().count() > 3
