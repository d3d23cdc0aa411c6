"""References to records that do not exist, and nested records to flat tables, against brute force."""

import json
import random
from datetime import datetime, timedelta

from quillmark.operators import references as refs
from quillmark.operators.nested import KINDS, NAMES, Flattening, StructuralIndex, flatten_records
from quillmark.operators.skew import hot_keys, salted_left_join

DAY = datetime(2024, 1, 1)
PARENT = "source_id string, item_id string, ingested_at timestamp, deleted_at timestamp, kind string"
CHILD = "source_id string, chunk_id string, item_ids array<string>, asset_ids array<string>, ingested_at timestamp, target_id string"


def orphans(spark, chunks, parents, least=50_000):
    c, p = spark.createDataFrame(chunks, CHILD), spark.createDataFrame(parents, PARENT)
    rows = refs.reference_rows(c, "chunks", "chunk_id", "ingested_at", [("item_ids", "item")])
    hot = hot_keys(rows, refs.KEY, 0, least=least)
    return {(r.record_id, r.target_id): r.reason for r in refs.orphan_references(rows, refs.validity(p, "item", "item_id"), hot).collect()}


def test_reasons_and_edge_cases(spark):
    at = lambda n: DAY + timedelta(days=n)
    parents = [("s", "a", at(1), None, "x"), ("s", "a", at(9), None, "x"), ("s", "b", at(5), None, None), ("s", "c", at(1), at(2), None), ("s", "c", at(6), at(8), None), ("t", "d", at(1), None, None), ("s", "e", None, None, None)]
    chunks = [
        ("s", "c1", [" a ", "a", "b", "c", "d", None, "", "　", "e"], None, at(3), None),
        ("s", "c2", ["b", "c"], None, at(7), "clash"),
        ("s", "c3", None, None, at(3), None),
        ("s", "c4", [], None, at(3), None),
        ("s", "c5", ["a"], None, None, None),
        (None, "c6", ["a"], None, at(3), None),
        ("s", "c1", ["zzz"], None, at(4), None),  # re-delivered later: the earliest counts
    ]
    want = {("c1", "b"): "late", ("c1", "c"): "deleted", ("c1", "d"): "missing", ("c1", "e"): "missing", ("c5", "a"): "late", ("c6", "a"): "missing"}
    assert orphans(spark, chunks, parents) == want
    assert orphans(spark, chunks, []) == {k: "missing" for k in [("c1", x) for x in "abcde"] + [("c2", "b"), ("c2", "c"), ("c5", "a"), ("c6", "a")]}
    assert orphans(spark, [], parents) == {}


def test_hot_keys_are_spread_without_loss(spark):
    rng = random.Random(1)
    parents = [("s", f"i{n}", DAY + timedelta(days=rng.randrange(9)), rng.choice([None, DAY + timedelta(days=rng.randrange(9, 20))]), None) for n in range(30)]
    chunks = [("s", f"c{n}", ["i0", f"i{rng.randrange(40)}"], None, DAY + timedelta(days=rng.randrange(20)), None) for n in range(400)]
    plain, spread = orphans(spark, chunks, parents), orphans(spark, chunks, parents, least=5)
    by_id = {p[1]: p for p in parents}
    want = set()
    for _, c, ids, _, at, _ in chunks:
        for i in set(ids):
            p = by_id.get(i)
            if p is None or p[2] > at or (p[3] is not None and p[3] <= at):
                want.add((c, i))
    assert plain == spread and set(plain) == want


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), (None, 2)], "k string, n int")
    right = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "k string, v string")
    hot = hot_keys(left, ["k"], 0, least=10)
    assert [r.k for r in hot.collect()] == ["a"]
    rows = salted_left_join(left, right, ["k"], hot, "n", salts=4).collect()
    assert len(rows) == 102 and sum(r.v is None for r in rows) == 2


def as_part(value):
    if isinstance(value, str):
        try:
            return as_part(json.loads(value)) if value.lstrip()[:1] in '{["' else None
        except ValueError:
            return None
    return value


def elements(value):
    value = as_part(value)
    if isinstance(value, dict):
        return [(1, value)]
    return [(i, x) for i, x in enumerate(value, 1) if x is not None] if isinstance(value, list) else []


def get(value, key):
    value = as_part(value)
    return value.get(key) if isinstance(value, dict) else None


def children_of(texts):
    return list(Flattening(KINDS, True).run(texts).itertuples(index=False, name=None))


def no_constant(name):
    raise ValueError(name)


def brute(text):
    try:
        r = json.loads(text, parse_constant=no_constant)
    except (ValueError, TypeError):
        return set()
    out = {("region", 0, p) for p, _ in elements(get(get(r, "bbox"), "regions"))}
    for p, s in elements(get(get(r, "provenance"), "steps")):
        out |= {("step", 0, p)} | {("warning", p, q) for q, _ in elements(get(s, "warnings"))}
    table = get(get(r, "content"), "table")
    for a, row in elements(get(table, "rows")):
        out |= {("cell", a, b) for b, _ in elements(row)}
    for _, c in elements(get(table, "cells")):
        if isinstance(get(c, "row"), int) and isinstance(get(c, "col"), int):
            out.add(("cell", c["row"] + 1, c["col"] + 1))
    return out


def random_value(rng, depth):
    text = rng.choice(["", "a", 'q"x', "\\", "{[", "]}:,", "日本", "\n"])
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, 3, -1.5, text])
    if rng.random() < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "steps", 'k"', "warnings"]): random_value(rng, depth - 1) for _ in range(rng.randrange(4))}


def test_nested_against_brute_force():
    rng = random.Random(7)
    texts = []
    for _ in range(400):
        parts = {}
        for path in (("bbox", "regions"), ("provenance", "steps"), ("content", "table")):
            inner = random_value(rng, 3) if path[1] != "table" else {"rows": random_value(rng, 3), "cells": [{"row": rng.randrange(3), "col": rng.randrange(3), "text": "x"}]}
            value = {path[1]: json.dumps(inner) if rng.random() < 0.2 else inner}
            parts[path[0]] = json.dumps(value) if rng.random() < 0.2 else value
        t = json.dumps(parts, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
        texts.append(t if rng.random() < 0.9 else t[: rng.randrange(len(t))])
    got = {(i, c, p, n) for i, c, p, n, _ in children_of(texts)}
    assert got == {(i, *row) for i, t in enumerate(texts) for row in brute(t)}


def test_nested_edge_cases(spark):
    deep = "[" * 200 + "]" * 200
    rows = [(1, None, "x"), (2, "", "x"), (3, '{"bbox": null}', None), (4, '{"bbox": {"regions": {"page": 1}}}', "x"), (5, f'{{"provenance": {{"steps": {deep}}}}}', "x"), (6, '{"semantic": {"entities": [null, {"mentions": {"start": 1}}]}}', "x"), (None, '{"bbox": {"regions": [1]}}', "x"), (4, '{"bbox": {"regions": {"page": 1}}}', "x")]
    df = spark.createDataFrame(rows, "raw_id bigint, record string, child string")
    got = sorted((r.raw_id, r.child, r.parent_pos, r.pos) for r in flatten_records(df).collect())
    assert got == [(4, "region", 0, 1), (4, "region", 0, 1), (5, "step", 0, 1), (6, "entity", 0, 2), (6, "mention", 2, 1)]
    assert flatten_records(df.where("false")).count() == 0
    assert children_of([]) == []


def test_nested_grammar_against_a_parser():
    rng = random.Random(11)
    texts = ["", " ", "null", "-0", "01", "1.", "1e5", '"a\tb"', '"\\u12g4"', '"\\x"', "NaN", "[1,]", '{"a":1,}', '{"a" 1}', '{1:2}', "[1 2]", "{}{}", '{"a":{"b":[]}}x', '["a":1]', '{"a","b"}', "[}", "]", '"', '\\"', "tru", "[true,false,null]", "\ufeff1", "[\v1]"]
    base = [json.dumps(random_value(rng, 4)) for _ in range(300)]
    for t in base * 6:
        t = list(t)
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randrange(3)] = rng.choice(['"', "\\", "{", "}", "[", "]", ",", ":", " ", "1", "e", "-", "n", "\n", ""])
        texts.append("".join(t))

    def valid(t):
        try:
            json.loads(t, parse_constant=no_constant)
        except ValueError:
            return False
        return True

    got = StructuralIndex([t.encode() for t in texts], NAMES).valid
    assert [t for t, g in zip(texts, got, strict=True) if bool(g) != valid(t)] == []
    assert 300 < sum(got) < len(texts)
    assert [bool(StructuralIndex([t.encode()], NAMES).valid[0]) for t in texts[:200]] == [valid(t) for t in texts[:200]]


def test_nested_has_no_greatest_depth():
    n = 100_000
    deep = '{"provenance": {"steps": [{"warnings": [' + "[" * n + "]" * n + "]}]}}"
    in_text = '"x"'
    for _ in range(12):
        in_text = json.dumps(in_text)
    texts = [deep, deep[:-1], json.dumps({"bbox": json.dumps({"regions": json.dumps([1, None, 2])}), "x": in_text})]
    assert {r[:4] for r in children_of(texts)} == {(0, "step", 0, 1), (0, "warning", 1, 1), (2, "region", 0, 1), (2, "region", 0, 3)}


def test_nested_kinds_and_places():
    record = json.dumps({"content": json.dumps({"semantic": {"entities": [{"mentions": [{}, {}]}]}}), "semantic": {"entities": [1, 2, 3]}})
    other = json.dumps({"content": {"semantic": None}, "semantic": {"entities": [{"mentions": {}}, 2]}})
    got = {r[:4] for r in children_of([record, other])}
    assert got == {(0, "entity", 0, 1), (0, "mention", 1, 1), (0, "mention", 1, 2), (1, "entity", 0, 1), (1, "entity", 0, 2), (1, "mention", 1, 1)}
    only = Flattening(("mention",), False).run([record, other])
    assert set(zip(only["record"], only["child"], only["parent_pos"], only["pos"], strict=True)) == {r for r in got if r[1] == "mention"}
