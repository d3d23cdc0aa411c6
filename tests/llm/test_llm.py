"""Operators on training text: brute force, round trips, held-out accuracy and edge cases."""

import random
import re
import string
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import language, leakage, mixing, queries, scans, spam, splitting

NOW = datetime(2024, 1, 1)


# ---- all queries ------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE[name])


COLUMNS = {"p1_found": ["rec_table", "rec_key", "line_no", "noise"], "p4_found": ["rec_table", "rec_key", "seg_no", "lang"], "p5_found": ["rec_table", "rec_key"], "p6_found": ["doc_id", "case_id"], "p8_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert df.columns == COLUMNS.get(name, df.columns)
    if name in COLUMNS:
        assert len(rows) == len(set(rows)) and rows


# ---- splitting --------------------------------------------------------------------------------------------------------
def test_pieces_round_trip():
    rng = random.Random(2)
    signs = string.ascii_letters + "   ..,;\n\n。，日本é́"
    for _ in range(300):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 900)))
        limit = rng.randrange(12, 300)
        overlap = rng.choice([0, limit // 10, limit // 3, limit, -4])
        pieces = splitting.pieces_of(text, limit, overlap)
        assert "".join(text[a:b] for a, b, _, _ in pieces) == text
        used = overlap if 0 < overlap < limit else 0
        for n, (a, b, o, _) in enumerate(pieces):
            assert b > a and b - a + o <= limit
            assert o == (0 if n == 0 else min(used, a))
    assert splitting.pieces_of("x" * 100_000, 1200, 120)[1][2] == 120
    a, b, _, name = splitting.pieces_of("First sentence here. Second one there.", 25, 0)[1]
    assert (a, name) == (21, "sentence")


def test_oversized_edge_cases(spark):
    limits = spark.createDataFrame([("package_items", "paragraph", 10, 2), ("package_items", "*", 5, None), ("chunks", "table", 4, 0)], "rec_table string, modality string, max_chars int, overlap_chars int")
    items = spark.createDataFrame(
        [("s", "a", NOW, "x" * 11, "paragraph", "clash"), ("s", "b", NOW, "x" * 10, "paragraph", ""), ("s", "c", NOW, "x" * 6, "other", ""), ("s", "d", NOW, None, None, ""), ("s", "e", NOW, "", "paragraph", ""), ("s", "f", NOW, "𝒳" * 10, "paragraph", ""), ("s", "a", datetime(2025, 1, 1), "x", "paragraph", ""), ("s", "g", NOW, "x" * 6, None, "")],
        "source_id string, item_id string, ingested_at timestamp, raw_text string, item_type string, `limit` string",
    )
    chunks = spark.createDataFrame([("s", "k", NOW, "ab cd", ["table"], ["i1", None]), ("s", "l", NOW, "ab cd", None, None), ("s", "m", NOW, "ab cd", ["other"], [])], "source_id string, chunk_id string, ingested_at timestamp, text string, modalities array<string>, item_ids array<string>")
    got = splitting.project_pieces(items, chunks, limits).collect()
    assert {r.rec_key for r in got} == {"s#a", "s#c", "s#g", "s#k"}
    assert {tuple(r.item_ids) for r in got if r.rec_key == "s#k"} == {("i1", None)}
    assert splitting.project_pieces(items.where("false"), chunks.where("false"), limits).count() == 0
    assert splitting.project_pieces(items, chunks, limits.where("false")).count() == 0


# ---- leakage ----------------------------------------------------------------------------------------------------------
def test_leaks_against_brute_force():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "x1", "2024"]
    cases = [(f"e{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))) for i in range(20)] + [(f"z{i}", "".join(rng.choice("图表检测系统质量") for _ in range(rng.randrange(10, 60)))) for i in range(8)]
    w, c, marked = leakage.automata(cases)
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            _, t = rng.choice(cases)
            i = rng.randrange(len(t))
            parts.append(t[i : i + rng.randrange(1, 90)].upper() if rng.random() < 0.5 else t[i : i + 60].replace(" ", ",\n"))
        text = rng.choice([" ", "noise", "。"]).join(parts)
        tokens = leakage.WORD.findall(leakage.normal(text))
        flat = "".join(tokens)
        want = set()
        for name, t in cases:
            own = leakage.WORD.findall(leakage.normal(t))
            if leakage.is_chinese(t):
                s = "".join(own)
                if any(s[i : i + 24] in flat for i in range(len(s) - 23)):
                    want.add(name)
            elif any(own[i : i + 12] == tokens[j : j + 12] for i in range(len(own) - 11) for j in range(len(tokens) - 11)):
                want.add(name)
        assert set(leakage.leaks_in(text, w, c, marked)) == want


def test_leak_edge_cases(spark):
    passage = " ".join(f"word{i}" for i in range(14))
    cases = spark.createDataFrame([("a", passage, None, "x"), ("b", passage, "", "x"), (None, passage, None, "x"), ("c", None, "short", "x")], "id string, question string, expected_answer string, doc_id string")
    docs = spark.createDataFrame([(1, f"pre {passage.upper()}! post", "k"), (1, f"pre {passage}", "k"), (2, None, "k"), (3, "", "k"), (None, passage, "k"), (4, "filler " * 200_000 + passage.replace("word", "ＷＯＲＤ"), "k"), (5, " ".join(passage.split()[:11]), "k")], "doc_id bigint, text string, case_id string")
    got = {(r.doc_id, r.case_id): r.longest for r in leakage.leaked_cases(docs, cases).collect()}
    assert got == {(d, c): 14 for d in (1, 4) for c in "ab"}
    cleaned = {r.doc_id: r.kept_text for r in leakage.without_leaks(docs.where("doc_id in (1, 4)"), cases).collect()}
    assert cleaned[4] == "filler " * 200_000 and cleaned[1] is None
    assert leakage.leaked_cases(docs.where("false"), cases).count() == 0 and leakage.leaked_cases(docs, cases.where("false")).count() == 0


def test_blocks_of_test_items_agree(spark, data, monkeypatch):
    whole = {tuple(r) for r in queries.p6_found(spark, data).collect()}
    monkeypatch.setattr(leakage, "BLOCK", 100)
    assert {tuple(r) for r in queries.p6_found(spark, data).collect()} == whole


# ---- language ---------------------------------------------------------------------------------------------------------
TEXTS = {
    "en": "The committee met in the morning and decided that the report should be published before the end of the month.",
    "de": "Der Ausschuss hat am Morgen beschlossen, dass der Bericht vor dem Ende des Monats veröffentlicht werden soll.",
    "fr": "Le comité a décidé ce matin que le rapport devait être publié avant la fin du mois pour tous les lecteurs.",
    "zh": "委员会在上午召开会议，并决定在月底之前发布这份报告，以便所有读者都能及时了解情况，同时安排了后续的工作。",
}


def coder():
    from collections import Counter

    return language.Coder({k: language.count_contexts(Counter(language.tokens_of(t))) for k, t in TEXTS.items()})


def test_code_lengths_are_probabilities():
    c = coder()
    for context in (b"", b" ", b" th", b"e r"):
        total = sum(np.exp2(-c.byte(context, b)[0]) for b in range(256))
        assert total <= 1 + 1e-6
    assert c.languages == ["en", "zh", "de", "fr"]


def test_segments():
    c = coder()
    mixed = f"{TEXTS['en']} {TEXTS['de']}\n\n{TEXTS['zh']}{TEXTS['zh']}"
    found = language.segments_of([mixed, TEXTS["fr"], "", "1234 !!", "ok", TEXTS["en"] + " 「" + TEXTS["de"].rstrip(".") + "」 in the report."], c)
    assert [[s[0] for s in own] for own in found] == [["en", "de", "zh"], ["fr"], [], [], [], ["en"]]
    assert all(0 <= s[4] <= 1 for own in found for s in own) and mixed[found[0][1][1] :].lstrip().startswith("Der")


def test_labels(spark):
    df = spark.createDataFrame([("en_GB",), ("中文",), ("zh_Hans",), ("Português",), (" DE-at ",), ("und",), ("",), (None,), ("mul",), ("n/a",)], "l string")
    assert [r.x for r in df.select(language.named_language(F.col("l")).alias("x")).collect()] == ["en", "zh", "zh", "pt", "de", None, None, None, None, None]


def test_language_tables(spark):
    rows = [("s", f"i{k}{n}", NOW, "paragraph", k, TEXTS[k]) for k in TEXTS for n in range(6)]
    rows += [("s", "wrong", NOW, "paragraph", "fr", TEXTS["de"]), ("s", "none", NOW, "paragraph", None, TEXTS["en"]), ("s", "mixed", NOW, None, "en", TEXTS["en"] + "\n\n" + TEXTS["de"]), ("s", "skip", NOW, "table", None, TEXTS["en"]), ("s", "null", NOW, "paragraph", None, None), ("s", "none", datetime(2025, 1, 1), "paragraph", None, TEXTS["en"])]
    items = spark.createDataFrame(rows, "source_id string, item_id string, ingested_at timestamp, item_type string, lang string, raw_text string").withColumn("segments", F.lit("clash"))
    chunks = spark.createDataFrame([("s", "c", NOW, ["table"], None, TEXTS["en"]), ("s", "d", NOW, None, "English", TEXTS["en"])], "source_id string, chunk_id string, ingested_at timestamp, modalities array<string>, lang string, text string")
    got = {(r.rec_key, r.seg_no): r.lang for r in language.label_cases(language.project_segments(items, chunks)).collect()}
    assert got == {("s#wrong", 0): "de", ("s#none", 0): "en", ("s#mixed", 1): "en", ("s#mixed", 2): "de"}
    assert language.project_segments(items.where("false"), chunks.where("false")).count() == 0
    assert language.label_cases(language.project_segments(items.where("lang is null"), chunks.where("false"))).count() == 0


def test_language_held_out(spark, data):
    """Segments agree with plain labels of chunks nearly always (labels are wrong at times)."""
    rows = queries.p4_segments(spark, data).where("rec_table = 'chunks' and declared is not null").collect()
    per = {}
    for r in rows:
        per.setdefault(r.rec_key, []).append(r)
    single = [own[0] for own in per.values() if len(own) == 1]
    assert sum(r.lang == r.declared for r in single) >= 0.85 * len(single)


# ---- mixing -----------------------------------------------------------------------------------------------------------
def test_allocation():
    have = {"a": 100, "b": 10}
    assert mixing.allocate({"a": (0.5, 1), "b": (0.5, 2)}, have) == {"a": 20.0, "b": 20.0}
    out = mixing.allocate({"a": (0.5, 1), "b": (0.5, 2), "none": (0.3, 5)}, have, total=100)
    assert out == {"b": 20.0, "a": 80.0}
    assert mixing.allocate({"a": (0.5, 0)}, have) == {} and mixing.allocate({}, have) == {}


def test_mix_shares_and_repeats(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(5, 60)))
    docs = [(i, text(), rng.choice(["Big Source", "big_source ", "BIG-SOURCE"]), 1) for i in range(1500)] + [(2000 + i, text(), "small", 1) for i in range(60)] + [(3000, None, "small", 1), (3001, "", "small", 1), (None, text(), None, 1), (3002, text(), "other", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tokens int")
    t = spark.createDataFrame([("big_source", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 9), ("nothing", None, None)], "source_name string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(d, t)
    shares = {r.source_name: r for r in report.collect()}
    assert abs(shares["small"].reached_share - 2 / 9) < 0.02 and abs(shares["big_source"].reached_share - 7 / 9) < 0.02
    assert shares["small"].most_copies == 3 and shares["big_source"].most_copies == 1 and shares["absent"].tokens == 0 and shares["nothing"].reached_share == 0
    rows = mix.collect()
    assert {r.source_name for r in rows} == {"big_source", "small"} and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    # any stretch of the mix has about the shares of the whole
    half = sorted(rows, key=lambda r: r.slot)[: len(rows) // 2]
    assert abs(sum(r.tokens for r in half if r.source_name == "small") / sum(r.tokens for r in half) - 2 / 9) < 0.06
    empty, zero = mixing.mix_sources(d.where("false"), t)
    assert empty.count() == 0 and {r.tokens for r in zero.collect()} == {0}


def test_ranks_of_slots(spark):
    df = spark.createDataFrame([("s", i // 7, i, 1 + i % 3) for i in range(50)] + [("t", 0, 0, 5)], "source_name string, bucket int, i int, n int")
    got = {r.i: r.before for r in mixing.ranked(df, ["bucket"], F.col("n"), ["i"], "before").where("source_name = 's'").collect()}
    total = 0
    for i in range(50):
        assert got[i] == total
        total += 1 + i % 3


def test_cleaned_texts_leak_nothing(spark, data, monkeypatch):
    import unicodedata

    item = "Où était l'été passé quand Zoë a préféré étudier à côté du café près d'ici déjà"
    zh = "总体来看煦禾研究所在珩岭分厂抽取了四十个样本用来评估风沙防护的实际效果"
    half = item.split()
    cases = spark.createDataFrame([("f", item, None), ("z", zh, "x"), ("e", "one two three four five six seven eight nine ten eleven twelve thirteen", None)], "id string, question string, expected_answer string")
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in "one two three four five six seven eight nine ten eleven twelve")
    texts = [item, unicodedata.normalize("NFD", item), unicodedata.normalize("NFD", item).upper() + "x" * 99, wide + " and more of it", "前言。" + zh[:12] + "，\n" + zh[12:] + "。后记" * 30, " ".join(half[:8]) + " " + item + " " + " ".join(half[8:]) + " fin" * 90, "nothing here", "ﾊﾟ" + item]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for block in (1, 20_000):
        monkeypatch.setattr(leakage, "BLOCK", block)
        rows = {r.doc_id: r for r in leakage.without_leaks(docs, cases).collect()}
        assert set(rows) == {0, 1, 2, 3, 4, 5, 7} and all(r.n_spans for r in rows.values())
        kept = spark.createDataFrame([(i, r.kept_text) for i, r in rows.items()], "doc_id bigint, text string")
        assert leakage.leaked_cases(kept, cases).count() == 0
        assert rows[4].kept_text.startswith("前言") and rows[4].kept_text.endswith("后记") and "fin" in rows[5].kept_text
    found = queries.p6_clean(spark, data).withColumnRenamed("kept_text", "text")
    assert leakage.leaked_cases(found, spark.read.parquet(f"{data}/eval_cases.parquet")).count() == 0 and found.count()


# ---- spam -------------------------------------------------------------------------------------------------------------
PROSE = "The committee met in the morning and decided that the report should be published. It was not clear whether the members of the board would agree with it."
SPAM = {
    "links": "\n".join(f"<a href=\"http://x{i}.example/p-{i}.html\">Title {i}</a>" for i in range(30)),
    "tags": "\n".join(f"brand:Widget {i % 4} / size:Large_{i}" for i in range(30)),
    "words": "cheap widget buy widget online best widget price " * 12,
    "glued": "cheapwidgetbuywidgetonline" * 20,
    "places": "\n".join(f"widget repair in Town{c}" for c in "abcdefghijklmnopqrstuv" * 2),
    "zh": "水泵价格水泵批发水泵图片水泵官网水泵优惠" * 10,
}


def test_long_words_and_quotes_have_a_language():
    c = coder()
    run_on = re.sub("[^a-zäöüß]", "", TEXTS["de"].lower()) * 3
    assert len(run_on) > 240
    assert [s[0] for s in language.segments_of([run_on], c)[0]] == ["de"]
    quote = (TEXTS["de"].rstrip(".") + ", " + TEXTS["de"].rstrip(".")).replace("\n", " ")
    assert len(quote) > 160
    assert [s[0] for s in language.segments_of([TEXTS["en"] + " It was called “" + quote + "” in the report of that year and in all the others."], c)[0]] == ["en"]


def test_sample_takes_each_text_once(spark):
    rows = [("en", "the same text in very many copies of one row")] * 3000 + [("en", f"text number {i} of this table") for i in range(500)]
    sample = language.training_rows(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert len(sample) == len(set(sample)) and 450 <= len(sample) <= 501


@pytest.mark.parametrize("kind", sorted(SPAM))
def test_spam_share(kind):
    assert spam.features(SPAM[kind])[1][0] > 0.5
    assert spam.features(PROSE + " " + PROSE + "\n" + PROSE)[1][0] < 0.1
    assert spam.features(PROSE * 20 + "\n" + SPAM[kind][:200])[1][0] < 0.5


def test_spam_tables(spark):
    rng = random.Random(1)
    words = ["report", "member", "board", "answer", "number", "meeting", "window", "garden", "paper", "table"]
    prose = [" ".join(f"The {rng.choice(words)} of the {rng.choice(words)} was not in the {rng.choice(words)} that is on the {rng.choice(words)}." for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    rows = [(i, t, "x") for i, t in enumerate(prose)] + [(1000 + i, t, "x") for i, t in enumerate(SPAM.values())] + [(1000, SPAM["links"], "x"), (2000, None, "x"), (2001, "", "x"), (2002, "\n" * 50, "x"), (None, SPAM["links"], "x"), (2003, "| a | b |\n| 1 | 2 |", "x"), (2004, PROSE * 3000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, language string")
    found = {r.doc_id for r in spam.spam_pages(spam.page_features(df).cache()).collect()}
    assert found == {1000 + i for i in range(len(SPAM))}
    assert spam.spam_pages(spam.page_features(df.where("false"))).count() == 0


def test_spam_comes_by_distance(spark, monkeypatch):
    """Recall and precision on planted pages of all shares and sizes; without the distance everything in the direction is spam."""
    rng = random.Random(4)
    words = ["report", "member", "board", "answer", "number", "meeting", "window", "garden", "paper", "table"]
    say = lambda: f"The {rng.choice(words)} of the {rng.choice(words)} was not in the {rng.choice(words)} that is on the {rng.choice(words)}."
    prose = [" ".join(say() for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    titles = [f"{rng.choice(words)} {rng.choice(words)} {i}" for i in range(40)]
    junk = {k: (v * 4)[: rng.randrange(500, 900)] for k, v in SPAM.items() if k != "zh"}
    mixed = lambda share: [" ".join(say() for _ in range(max(1, round(len(v) * (1 - share) / share / 62)))) + "\n" + v for v in junk.values()]
    good = prose + titles + mixed(0.2) + mixed(0.3)
    bad = mixed(0.7) + mixed(0.9) + ["cheap widget buy widget best widget cheap widget buy widget online"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    features = spam.page_features(df).cache()
    found = {r.doc_id for r in spam.spam_pages(features).collect()}
    true = set(range(len(good), len(good + bad)))
    assert len(found & true) >= 0.98 * len(true) and len(found & true) >= 0.99 * len(found)
    monkeypatch.setattr(spam, "FAR", 0.0)
    assert len(spam.spam_pages(features).collect()) > len(found)


def test_spam_copies_are_the_most_of_a_language(spark):
    rng = random.Random(2)
    nouns = ["report", "member", "board", "answer", "number", "meeting", "window", "garden", "paper", "table"]
    prose = [" ".join(f"The {rng.choice(nouns)} of the {rng.choice(nouns)} was not in the {rng.choice(nouns)} that is on the {rng.choice(nouns)}." for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    things = ["会议", "报告", "系统", "数据", "质量", "设备", "工程", "材料"]
    chinese = ["".join(f"{rng.choice(things)}{rng.choice(things)}的{rng.choice(things)}在{rng.choice(things)}完成后由{rng.choice(things)}部门进行检查。" for _ in range(rng.randrange(4, 9))) for _ in range(230)]
    shops = [f"{a}{b}价格{a}{b}批发{a}{b}图片{a}{b}官网{a}{b}优惠" * 10 for a in "水油气风电热冷光声磁木石铁铜金银" for b in "泵阀管板灯机箱桶布线门窗锁柜床椅"]
    assert spam.features(shops[0])[:1] == ("zh",) and all(spam.features(t)[1][0] > 0.5 for t in shops) and all(spam.features(t)[1][0] <= 0.5 for t in chinese + prose)

    def found(pages):
        rows = list(enumerate(prose + chinese + pages))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return {r.doc_id for r in spam.spam_pages(spam.page_features(df).cache()).collect()}

    first = len(prose + chinese)
    # one group of copies is a third of all rows and most of its language; then as many different pages
    assert found([SPAM["zh"]] * 565) == set(range(first, first + 565))
    assert found(shops) == set(range(first, first + len(shops)))


# ---- scans ------------------------------------------------------------------------------------------------------------
def noisy_tables(spark, clash=False):
    names = ["survey", "report", "committee", "department", "material", "furnace", "returns"]
    rng = random.Random(6)
    line = lambda: f"the {rng.choice(names)} of the {rng.choice(names)} was checked and the {rng.choice(names)} was kept in the {rng.choice(names)}"
    texts = ["\n".join(line() for _ in range(4)) for _ in range(60)]
    texts[0] = "12\nthe survey of the depart-\nment was kept in the rnaterial\nAcme Works — Guide  12\nand the comm-\n\nInternal draft\nittee was checked\nStep 3\nthe furnacc, both in- and outbound"
    rows = [("s", f"i{n}", NOW, "paragraph", t) for n, t in enumerate(texts)]
    rows += [("s", "h1", NOW, "page_header", "Acme Works — Guide"), ("s", "null", NOW, "paragraph", None), ("s", "empty", NOW, None, ""), ("s", "one", NOW, "paragraph", "Guide"), ("s", "title", NOW, "title", "Guide\n12"), ("s", "i0", datetime(2025, 1, 1), "paragraph", "other"), (None, "nokey", NOW, "paragraph", "a\nb")]
    rows += [(f"p{i}", "h", NOW, "page_footer", "Internal draft") for i in range(4)]
    items = spark.createDataFrame(rows, "source_id string, item_id string, ingested_at timestamp, item_type string, raw_text string")
    cache = spark.createDataFrame([("aa", ("ready", "Internal draft\nthe survey was kept in the re-\nport\nAcme Works — Guide"), NOW), ("bb", None, NOW), ("cc", ("failed", None), None)], "sha256 string, ocr struct<status:string,text:string>, generated_at timestamp")
    packages = spark.createDataFrame([("s", "Guide"), ("t", None)] + [(f"p{i}", f"P {i}") for i in range(4)], "package_id string, title string")
    assets = spark.createDataFrame([("s", "a1", " AA "), ("t", "a2", "aa"), ("t", "a3", None)], "source_id string, asset_id string, sha256 string")
    if clash:
        items, cache, assets = (d.withColumn("keys", F.lit(1)).withColumn("text", F.lit("x")).withColumn("key", F.lit(2)) for d in (items, cache, assets))
    return items, cache, packages, assets


@pytest.mark.parametrize("clash", [False, True])
def test_scans(spark, clash):
    rows = scans.read_scans(*noisy_tables(spark, clash), repair=True).collect()
    by = {(r.rec_table, r.rec_key): r for r in rows}
    events = lambda r: {(e.line_no, e.noise) for e in r.events}
    assert events(by["package_items", "s#i0"]) == {(1, "furniture"), (2, "hyphen"), (3, "char"), (4, "furniture"), (5, "hyphen"), (7, "furniture"), (10, "char")}
    assert by["package_items", "s#i0"].repaired == "the survey of the department was kept in the material and the committee was checked Step 3 the furnace, both in- and outbound"
    assert events(by["visual_cache", "aa"]) == {(1, "furniture"), (2, "hyphen"), (4, "furniture")}
    assert not by["package_items", "s#one"].events and not by["package_items", "s#title"].events
    assert all(not r.events for k, r in by.items() if re.fullmatch(r"s#i[1-9]\d?", k[1]))


def test_scan_copies_count_once(spark):
    items, cache, packages, assets = noisy_tables(spark)
    copy = "the committec was kept\nby the comrnittee of the furnacc"
    more = spark.createDataFrame([("s", f"copy{n}", NOW, "paragraph", copy) for n in range(60)], items.schema)
    got = {r.rec_key: r for r in scans.read_scans(items.unionByName(more), cache, packages, assets, repair=True).collect()}
    for n in range(60):
        assert {(e.line_no, e.noise) for e in got[f"s#copy{n}"].events} == {(1, "char"), (2, "char")}
        assert got[f"s#copy{n}"].repaired == "the committee was kept by the committee of the furnace"
    spoken = scans.spoken_texts(items.unionByName(more).select(F.col("raw_text").alias("text"), F.lit(False).alias("keep")).where("text <> ''"))
    words = {r.word: r.n for r in scans.word_sums(spoken, ["the"], np.zeros((1, scans.DIMENSIONS)), np.ones(1)).collect()}
    assert words["committec"] == words["comrnittee"] == 1


def test_scan_links_in_blocks_agree(spark, monkeypatch):
    tables = noisy_tables(spark)
    get = lambda: {(r.rec_key, e.line_no, e.noise) for r in scans.read_scans(*tables).collect() for e in r.events}
    whole = get()
    monkeypatch.setattr(scans, "MOST_LINKS", 1)
    monkeypatch.setattr(scans, "MOST_KEYS", 0)  # the salted join instead of the broadcast
    assert get() == whole


def test_scan_links_beyond_the_broadcast_repair_alike(spark, monkeypatch):
    items, cache, packages, assets = noisy_tables(spark)
    wrong = "the rnaterial of the furnacc was checked\nby the comrnittee and the departrnent\nof the rcport and the retums and the rnate-\nrial"
    more = spark.createDataFrame([("s", f"wrong{n}", NOW, "paragraph", wrong) for n in range(3)], items.schema)
    get = lambda: {r.rec_key: (sorted((e.line_no, e.noise) for e in r.events), r.repaired) for r in scans.read_scans(items.unionByName(more), cache, packages, assets, repair=True).collect()}
    whole = get()
    assert whole["s#wrong0"][1] == "the material of the furnace was checked by the committee and the department of the report and the returns and the material"
    monkeypatch.setattr(scans, "MOST_LINKS", 1)
    assert get() == whole


def test_scans_of_empty_tables(spark):
    assert scans.read_scans(*[d.where("false") for d in noisy_tables(spark)]).count() == 0


def test_numbers_with_letters():
    reader = scans.Reader({}, {}, scans.Space([], np.zeros((0, scans.DIMENSIONS)), np.zeros(0), np.eye(scans.DIMENSIONS)))
    events, text = reader.read("fell from 9.S to l,0l3 percent and B105 rose\nin 2O24 by e.g. 3.5 or U.S. units", (), False, True)
    assert sorted(events) == [(1, "char"), (2, "char")] and text == "fell from 9.5 to 1,013 percent and B105 rose in 2024 by e.g. 3.5 or U.S. units"


def test_page_lines():
    yes = ["12", "- 12 -", "~ 7 ~", "Page 3", "Page 3 of 9", "p. 4", "[22]", "xviii", "第 6 页", "第3页 共9页", "· 5 ·"]
    no = ["2019.", "Step 3", "序号8", "12 units", "model", "", "A 12", "3.9%"]
    assert all(map(scans.is_page_number, yes)) and not any(map(scans.is_page_number, no))
    assert scans.key("Intemal draft") == scans.key("Internal draft") == scans.key("INTERNAL  DRAFT")
    assert scans.broken("the inspect-", "ion was") == ("inspect", "ion") and scans.broken("both in-", "and out") is None and scans.broken("1-", "2") is None


def test_word_sums_in_parts(spark, monkeypatch):
    texts = ["the sur-\nvey of the report", "12\nthe 报告由库存 report", "", "x\n\ny"] + [f"the word{i} of the report" for i in range(40)]
    spoken = scans.spoken_texts(spark.createDataFrame([(t, False) for t in texts], "text string, keep boolean"))
    assert {p for r in spoken.collect() for p in r.pairs.split("\n")} == {"", "告由", "由库", "库存"}
    table = np.random.default_rng(1).normal(size=(2, scans.DIMENSIONS))
    sums = lambda: {r.word: (r.n, round(r.v0, 3), round(r.v31, 3)) for r in scans.word_sums(spoken, ["the", "report"], table, np.ones(2)).collect()}
    whole = sums()
    assert whole["survey"][0] == 1 and whole["the"][0] == 83 and "12" not in whole
    assert abs(whole["word7"][1] - (2 * table[0][0] + table[1][0])) < 0.01
    monkeypatch.setattr(scans, "MOST_WORDS", 3)
    assert sums() == whole
    monkeypatch.setattr(scans, "STRETCH", 4)
    assert sums() == whole


def contextual(spark, seed=3):
    """Texts in which modem is a word of its own beside routers, and twice a misreading of modern beside buildings."""
    rng = random.Random(seed)
    net = lambda w: f"the router and the cable of the {w} with signal and port were tested in the network by {rng.choice(['them', 'us', 'staff'])}"
    house = lambda w: f"a {w} building with garden and tower was designed for the city by {rng.choice(['them', 'us', 'staff'])}"
    texts = [net("modem") for _ in range(12)] + [net(rng.choice(["switch", "server"])) for _ in range(60)] + [house("modern") for _ in range(150)] + [house(rng.choice(["large", "small"])) for _ in range(60)]
    texts = [f"{t} on day {n}" for n, t in enumerate(texts)] + [house("modem") + " in spring\nand a third line", net("modem") + " in spring\nand a third line", house("modcrn") + " in May"]
    rows = [("s", f"i{n}", NOW, "paragraph", t) for n, t in enumerate(texts)]
    items = spark.createDataFrame(rows, "source_id string, item_id string, ingested_at timestamp, item_type string, raw_text string")
    _, cache, packages, assets = noisy_tables(spark)
    return (items, cache, packages, assets), len(texts)


@pytest.mark.parametrize("links", [50_000, 0])
def test_words_are_corrected_in_context(spark, monkeypatch, links):
    """One word is corrected in one context and left in another; without the vectors it is not."""
    monkeypatch.setattr(scans, "MOST_LINKS", links)
    tables, n = contextual(spark)
    read = lambda: {r.rec_key: r.repaired for r in scans.read_scans(*tables, repair=True).collect() if r.rec_table == "package_items"}
    got = read()
    assert "a modern building" in got[f"s#i{n - 3}"] and "of the modem with" in got[f"s#i{n - 2}"] and "a modern building" in got[f"s#i{n - 1}"]
    assert all("modem" in got[f"s#i{i}"] for i in range(12))
    monkeypatch.setattr(scans, "train_vectors", lambda counts: (np.ones((len(counts), scans.DIMENSIONS)),) * 2)
    assert read() != got


def test_trained_vectors_tell_contexts_apart(spark):
    (items, *_), _ = contextual(spark)
    vocabulary, space = scans.learn(scans.spoken_texts(items.select(F.col("raw_text").alias("text"), F.lit(False).alias("keep"))).cache())
    v = {r.word: space.vector(np.array(r[3:], float), r.near) for r in vocabulary.collect()}
    assert scans.cosine(v["large"], v["small"]) > 0.8 > 0.3 > scans.cosine(v["large"], v["server"])
    assert scans.cosine(v["modcrn"], v["modern"]) > scans.cosine(v["modem"], v["modern"])


def test_scans_have_no_longest_line(spark):
    long = "Proceedings of the " + "very " * 20 + "long committee on running headers of any length"
    assert len(long) > 116
    rows = [("s", "h", NOW, "page_header", long)] + [("s", f"i{n}", NOW, "paragraph", f"{long} {n}\nthe text goes on and\non") for n in range(2)]
    items = spark.createDataFrame(rows, "source_id string, item_id string, ingested_at timestamp, item_type string, raw_text string")
    _, cache, packages, assets = noisy_tables(spark)
    got = {r.rec_key: {(e.line_no, e.noise) for e in r.events} for r in scans.read_scans(items, cache, packages, assets).collect()}
    assert got["s#i0"] == got["s#i1"] == {(1, "furniture")}


def test_status_lines_beyond_the_broadcast(spark, monkeypatch):
    tables = noisy_tables(spark)
    texts = lambda: {(r.rec_key, r.text): set(r.keys) for r in scans.scanned_texts(*tables)[0].collect()}
    plain, status = texts(), scans.scanned_texts(*tables)[1]
    assert status == {scans.key("Internal draft")}
    monkeypatch.setattr(scans, "MOST_KEYS", -1)
    joined = texts()
    assert all(joined[k] - plain[k] <= status for k in plain) and any(joined[k] != plain[k] for k in plain)


def test_signs_are_repaired_beside_words():
    right = {"rnodern": scans.Link([("modern", 99, True, 1.0, 1.0, [1.0] * scans.DIMENSIONS, [1.0] * scans.DIMENSIONS)])}
    reader = scans.Reader(right, {"已经": 500, "说已": 20}, scans.Space([], np.zeros((0, scans.DIMENSIONS)), np.zeros(0), np.eye(scans.DIMENSIONS)))
    events, text = reader.read("A rnodern report says 己经 done in 2O24\nnext rnod-\nern line", (), False, True)
    assert text == "A modern report says 已经 done in 2024 next modern line" and sorted(events) == [(1, "char"), (2, "char"), (2, "hyphen")]


def test_language_cache_may_be_dropped(monkeypatch):
    c = coder()
    want, _ = c.lengths(list(TEXTS.values()))
    monkeypatch.setattr(language, "MOST_WORDS", 3)
    for _ in range(2):
        got, _ = c.lengths(list(TEXTS.values()))
        assert np.allclose(got, want)
