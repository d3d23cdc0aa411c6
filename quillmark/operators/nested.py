"""Deeply nested records to linked flat tables (problem 3), by vectorised structural indexing.

A batch of records is laid out as one byte buffer. Bitmaps of quotes, backslashes, brackets and delimiters are built with
numpy; the parity of unescaped quotes tells strings from structure; prefix sums of brackets, restarted at each record, give
the nesting depth. A stable sort of the tokens by (record, depth) puts each container beside its own members, so all spans
of keys and values come out without a walk over the text, at any depth. The grammar is checked on the same arrays: which
token may follow which in which kind of container, escapes, numbers and words. Paths are followed for all records of a batch
at once. Values that hold JSON as text are decoded and indexed in the next round, again as one buffer.

Defined results: null, blank or broken records have no rows (the full JSON grammar counts, so NaN or Infinity break a
record); of a repeated key the last one counts; a null element keeps its position but is no child; an object in place of an
array is its only element; numbers or strings that are not JSON in place of an array have no children; other columns of the
input are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.tables import spread

#: record, kind of child, position of the parent and of the child, the value as JSON text
CHILD_SCHEMA = "raw_id bigint, child string, parent_pos int, pos int, value string"
BLOCK_BYTES = 1 << 19
OBJECT, OBJECT_END, ARRAY, ARRAY_END, COMMA, COLON, STRING, SCALAR = range(1, 9)
CODES = np.zeros(256, np.int8)
CODES[list(b"{}[],:")] = [OBJECT, OBJECT_END, ARRAY, ARRAY_END, COMMA, COLON]
BLANK, ESCAPED, HEX = (np.zeros(256, bool) for _ in range(3))
BLANK[list(b" \t\r\n")] = True
ESCAPED[list(b'"\\/bfnrtu')] = True
HEX[list(b"0123456789abcdefABCDEF")] = True
PLAIN = re.compile(rb"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


class StructuralIndex:
    """Spans of all keys and values in a batch of (one or more) JSON texts, and which texts are JSON.

    ``valid`` tells for each text whether it is; ``roots`` has the element of each valid text (-1 otherwise). Elements are
    numbered in the order of (text, depth, place): ``start`` and ``end`` of their bytes, the container they lie in
    (``inside``) and the one they open (``opens``, -1 for none), ``place`` in it from 1, and the bytes of their key.
    """

    def __init__(self, texts: list[bytes], names: tuple[str, ...]):
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        self.buffer = b"\n".join(texts) + b"\n" + b" " * 6
        data = self.data = np.frombuffer(self.buffer, np.uint8)
        where = np.arange(len(data))
        record = np.append(np.repeat(np.arange(len(texts)), sizes + 1), np.full(6, len(texts) - 1))
        broken = np.zeros(len(texts), bool)
        # quote bitmap without escaped quotes: a byte is escaped by an odd run of backslashes before it
        slash = data == 0x5C
        plain_before = np.maximum.accumulate(np.where(slash, -1, where))
        escapes = np.flatnonzero(slash)
        escapes = escapes[(escapes - plain_before[escapes]) % 2 == 1]
        quote = data == 0x22
        quote[escapes + 1] = False
        # in-string bitmap: parity of the quotes since the start of the record
        count = np.cumsum(quote)
        before = np.where(starts > 0, count[np.maximum(starts - 1, 0)], 0)
        inside = ((count - before[record]) & 1) == 1
        # a text that ends in a string is broken; none of its bytes count
        broken |= inside[starts + sizes]
        inside |= broken[record]
        quote &= ~broken[record]
        # in strings: no control bytes, known escapes only
        broken[record[inside & (data < 0x20)]] = True
        own = escapes[inside[escapes]]
        after = data[own + 1]
        broken[record[own[~ESCAPED[after]]]] = True
        wide = own[after == 0x75]
        for k in range(2, 6):
            broken[record[wide[~HEX[data[np.minimum(wide + k, len(data) - 1)]]]]] = True
        # tokens: brackets and delimiters, strings, runs of other bytes
        code = np.where(inside, 0, CODES[data])
        first_quote, last_quote = np.flatnonzero(quote & inside), np.flatnonzero(quote & ~inside)
        run = ~inside & ~quote & (code == 0) & ~BLANK[data]
        edge = np.diff(np.concatenate([[False], run, [False]]).astype(np.int8))
        run_start, run_end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        wrong = {x for x in {self.buffer[a:b] for a, b in zip(run_start.tolist(), run_end.tolist(), strict=True)} if not PLAIN.fullmatch(x)}
        if wrong:
            broken[[record[a] for a, b in zip(run_start.tolist(), run_end.tolist(), strict=True) if self.buffer[a:b] in wrong]] = True
        spot = np.flatnonzero(code)
        begin = np.concatenate([spot, first_quote, run_start])
        finish = np.concatenate([spot + 1, last_quote + 1, run_end])
        kind = np.concatenate([code[spot], np.full(len(first_quote), STRING, np.int8), np.full(len(run_start), SCALAR, np.int8)])
        order = np.argsort(begin, kind="stable")
        begin, finish, kind = begin[order], finish[order], kind[order]
        rec = record[begin]
        new = np.append(True, rec[1:] != rec[:-1]) if len(rec) else np.zeros(0, bool)
        prev = np.where(new, 0, np.append(0, kind[:-1])) if len(rec) else kind
        nxt = np.where(np.append(new[1:], True), 0, np.append(kind[1:], 0)) if len(rec) else kind
        # depth by prefix sums, restarted at each record; a bracket and what lies between share a depth
        opener, closer = (kind == OBJECT) | (kind == ARRAY), (kind == OBJECT_END) | (kind == ARRAY_END)
        total = np.cumsum(opener.astype(np.int64) - closer)
        first = np.searchsorted(begin, starts)
        base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(len(texts), np.int64)
        depth = total - base[rec]
        last = np.flatnonzero(np.append(new[1:], True)) if len(rec) else first[:0]
        broken[rec[last[depth[last] != 0]]] = True
        broken[rec[depth < 0]] = True
        level = depth + closer
        # an opening bracket stands twice: as a member of the outer container and as the start of its own
        token = np.concatenate([np.arange(len(kind)), np.flatnonzero(opener)])
        member = np.concatenate([(kind == STRING) | (kind == SCALAR), np.ones(int(opener.sum()), bool)])
        starter = np.concatenate([opener, np.zeros(int(opener.sum()), bool)])
        height = np.concatenate([level, level[opener] - 1])
        order = np.lexsort((token, height, rec[token]))
        token, member, starter, height = token[order], member[order], starter[order], height[order]
        container = np.cumsum(starter) - 1
        of_kind = kind[token[starter]]
        around = np.where((height > 0) & (container >= 0), of_kind[np.maximum(container, 0)], 0) if len(of_kind) else np.zeros(len(token), np.int8)
        enclosing = np.zeros(len(kind), np.int8)
        enclosing[token[~starter]] = around[~starter]
        value_before = np.isin(prev, (STRING, SCALAR, OBJECT_END, ARRAY_END))
        is_key = (kind == STRING) & (enclosing == OBJECT) & ((prev == OBJECT) | (prev == COMMA))
        after_key = np.append(False, is_key[:-1]) if len(kind) else is_key
        starts_value = (kind == STRING) | (kind == SCALAR) | opener
        good = np.ones(len(kind), bool)
        good[is_key] = nxt[is_key] == COLON
        plain = starts_value & ~is_key
        good[plain] = np.select([enclosing[plain] == OBJECT, enclosing[plain] == ARRAY], [prev[plain] == COLON, (prev[plain] == ARRAY) | (prev[plain] == COMMA)], prev[plain] == 0)
        good[kind == COMMA] = (value_before & (enclosing > 0) & ~after_key)[kind == COMMA]
        good[kind == COLON] = (after_key & (enclosing == OBJECT))[kind == COLON]
        own_kind = np.zeros(len(kind), np.int8)
        ends_own = closer[token]
        own_kind[token[ends_own]] = around[ends_own]
        good[closer] = ((own_kind == kind - 1) & ((prev == kind - 1) | value_before & ~after_key))[closer]
        broken[rec[~good]] = True
        has = np.zeros(len(broken), bool)
        has[rec] = True
        self.valid = has & ~broken
        # the members of all containers of the valid texts, in the order of their containers
        commas = np.cumsum(kind[token] == COMMA)
        origin = commas[starter]
        closing = np.zeros(len(of_kind), np.int64)
        closing[container[ends_own & (container >= 0)]] = finish[token[ends_own & (container >= 0)]]
        opened = np.full(len(kind), -1, np.int64)
        opened[token[starter]] = np.arange(len(of_kind))
        keep = member & self.valid[rec[token]] & ~is_key[token]
        at = token[keep]
        self.record, self.start, self.opens = rec[at], begin[at], opened[at]
        self.end = np.where(self.opens >= 0, closing[np.maximum(self.opens, 0)] if len(closing) else 0, finish[at])
        root = height[keep] == 0
        self.inside = np.where(root, -1, container[keep])
        self.place = np.where(root, 1, commas[keep] - origin[np.maximum(container[keep], 0)] + 1) if len(origin) else np.ones(len(at), np.int64)
        self.roots = np.full(len(texts), -1, np.int64)
        self.roots[self.record[root]] = np.flatnonzero(root)
        self.first_byte = data[self.start]
        self.null = (self.first_byte == 0x6E) & (self.end - self.start == 4)
        # members by container; the members with one of the names, the last of each name and container
        self.by_container = np.flatnonzero(~root)
        self.containers = self.inside[self.by_container]
        keyed = np.flatnonzero(~root & (prev[at] == COLON))
        spans = zip(begin[at[keyed] - 2].tolist(), finish[at[keyed] - 2].tolist(), strict=True)
        wanted = {b'"' + n.encode() + b'"': i for i, n in enumerate(names)}
        key = np.array([wanted.get(k, -1) if b"\\" not in (k := self.buffer[a:b]) else wanted.get(b'"' + json.loads(k).encode("utf-8", "replace") + b'"', -1) for a, b in spans], np.int64)
        self.named: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for i, n in enumerate(names):
            own = keyed[key == i]
            home = self.inside[own]
            final = np.append(home[1:] != home[:-1], True) if len(home) else np.zeros(0, bool)
            self.named[n] = home[final], own[final]

    def field(self, elements: np.ndarray, name: str) -> np.ndarray:
        """The member of a name of each element (-1: no element, no object, no such key or null)."""
        homes, members = self.named[name]
        if not len(homes):
            return np.full(len(elements), -1, np.int64)
        home = np.where(elements >= 0, self.opens[elements], -1)
        spot = np.minimum(np.searchsorted(homes, home), len(homes) - 1)
        found = np.where((home >= 0) & (homes[spot] == home), members[spot], -1)
        return np.where((found >= 0) & ~self.null[found], found, -1)

    def members(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the element, member, place) of the members of arrays, without nulls; an object is its own only one."""
        array = np.flatnonzero((elements >= 0) & (self.first_byte[elements] == 0x5B)) if len(elements) else elements
        home = self.opens[elements[array]]
        lo, hi = np.searchsorted(self.containers, home, "left"), np.searchsorted(self.containers, home, "right")
        size = hi - lo
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        member = self.by_container[np.repeat(lo, size) + step] if size.sum() else np.zeros(0, np.int64)
        source, place = np.repeat(array, size), self.place[member]
        alone = np.flatnonzero((elements >= 0) & (self.first_byte[elements] == 0x7B)) if len(elements) else elements
        source, member, place = np.concatenate([source, alone]), np.concatenate([member, elements[alone]]), np.concatenate([place, np.ones(len(alone), np.int64)])
        real = ~self.null[member]
        return source[real], member[real], place[real]

    def text(self, element: int) -> bytes:
        return self.buffer[self.start[element] : self.end[element]]


#: kind of child -> paths of its array in the record; of several, the first whose part is there counts
PARTS = {
    "region": (("bbox", "regions"),),
    "step": (("provenance", "steps"),),
    "table": (("content", "table"),),
    "entity": (("content", "semantic", "entities"), ("semantic", "entities")),
    "relation": (("content", "semantic", "relations"), ("semantic", "relations")),
}
#: the children of a child: field and kind
INNER = {"step": ("warnings", "warning"), "entity": ("mentions", "mention")}
#: what has to be walked for a kind of child
WALKED = {"cell": "table", "warning": "step", "mention": "entity"}
NAMES = ("bbox", "regions", "provenance", "steps", "content", "table", "semantic", "entities", "relations", "warnings", "mentions", "rows", "cells", "row", "col")
KINDS = ("region", "step", "warning", "cell", "entity", "relation", "mention")


def whole_number(text: bytes | None) -> int | None:
    """An index of a cell, also where it is written as text or with a zero fraction."""
    try:
        value = float(text.strip(b'"')) if text is not None else None
    except ValueError:
        return None
    return int(value) if value is not None and abs(value) < 2**31 and value == int(value) else None


class Flattening:
    """The children of a batch of records; rounds of JSON text within JSON text follow one another."""

    def __init__(self, kinds: tuple[str, ...], values: bool):
        self.kinds, self.values = set(kinds), values
        self.parts = {k: p for k, p in PARTS.items() if k in {WALKED.get(x, x) for x in kinds}}
        self.out: list[tuple[np.ndarray, str, np.ndarray, np.ndarray, list, int]] = []
        self.later: list[tuple] = []
        self.inner: set[int] = set()  # records with a semantic part in their content

    def run(self, texts: list[str | None]) -> pd.DataFrame:
        """record (number), child, parent_pos, pos, value"""
        numbers = np.array([i for i, t in enumerate(texts) if t], np.int64)
        if not len(numbers):
            return self.table()
        self.index = StructuralIndex([texts[i].encode("utf-8", "surrogatepass") for i in numbers.tolist()], NAMES)
        own = np.flatnonzero(self.index.valid)
        for kind, paths in self.parts.items():
            for rank, path in enumerate(paths):
                self.walk(numbers[own], self.index.roots[own], path, kind, np.zeros(len(own), np.int64), rank)
        while self.later:
            work, self.later = self.later, []
            self.index = StructuralIndex([w[1] for w in work], NAMES)
            groups: dict[tuple, list[int]] = {}
            for n, w in enumerate(work):
                if self.index.valid[n]:
                    groups.setdefault(w[2:5], []).append(n)
            for (path, kind, rank), own in groups.items():
                self.walk(np.array([work[n][0] for n in own]), self.index.roots[own], path, kind, np.array([work[n][5] for n in own]), rank)
        return self.table()

    def table(self) -> pd.DataFrame:
        parts = []
        for record, child, parent, pos, value, rank in self.out:
            part = pd.DataFrame({"record": record, "child": child, "parent_pos": parent, "pos": pos})
            if self.values:
                part["value"] = value
            # a semantic part in the content hides one at the top
            parts.append(part[~part["record"].isin(self.inner)] if rank else part)
        whole = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"record": [], "child": [], "parent_pos": [], "pos": []})
        return whole if "value" in whole else whole.assign(value=None)

    def unfold(self, record, element, path, kind, parent, rank):
        """What is there of the elements; those that are text are put off if they may hold JSON."""
        there = element >= 0
        string = there & (self.index.first_byte[np.maximum(element, 0)] == 0x22) if len(element) else there
        for n in np.flatnonzero(string).tolist():
            inner = json.loads(self.index.text(element[n]))
            if inner.lstrip(" \t\r\n")[:1] in ("{", "[", '"'):
                self.later.append((int(record[n]), inner.encode("utf-8", "surrogatepass"), path, kind, rank, int(parent[n])))
        keep = there & ~string
        return record[keep], element[keep], parent[keep]

    def walk(self, record, element, path, kind, parent, rank=0) -> None:
        """Follow a path from the elements and take what it leads to as arrays of a kind of child."""
        index = self.index
        for n, name in enumerate(path):
            record, element, parent = self.unfold(record, element, path[n:], kind, parent, rank)
            element = index.field(element, name)
            if not rank and name == "semantic":
                self.inner.update(record[element >= 0].tolist())
        record, element, parent = self.unfold(record, element, (), kind, parent, rank)
        if not len(element):
            return
        if kind == "table":
            for name in ("rows", "cells"):
                self.walk(record, index.field(element, name), (), name, parent)
            return
        source, member, place = index.members(element)
        own, above = record[source], parent[source]
        if kind == "rows":
            self.walk(own, member, (), "row", place)
        elif kind == "cells":
            self.walk(own, member, (), "placed", place)
        elif kind == "row":
            self.add(own, "cell", above, place, member)
        elif kind == "placed":
            spots = [[whole_number(index.text(e)) if e >= 0 else None for e in index.field(element, c).tolist()] for c in ("row", "col")]
            placed = np.array([r is not None and c is not None for r, c in zip(*spots, strict=True)], bool)
            row, col = (np.array([x for x, ok in zip(xs, placed, strict=True) if ok], np.int64) for xs in spots)
            self.add(record[placed], "cell", row + 1, col + 1, element[placed])
        else:
            if kind in self.kinds:
                self.add(own, kind, above, place, member, rank)
            if kind in INNER and INNER[kind][1] in self.kinds:
                self.walk(own, member, (INNER[kind][0],), INNER[kind][1], place, rank)

    def add(self, record, child, parent, pos, element, rank=0) -> None:
        value = [self.index.text(e).decode("utf-8", "replace") for e in element.tolist()] if self.values else None
        if len(record):
            self.out.append((record, child, parent, pos, value, rank))


def flatten_records(records: DataFrame, key: str = "raw_id", text: str = "record", kinds: tuple[str, ...] = KINDS, values: bool = True) -> DataFrame:
    """Linked child rows of nested records: CHILD_SCHEMA, one row per child of the given kinds (``value`` null if not asked for).

    A map over Arrow batches without a shuffle; records are indexed together up to BLOCK_BYTES, a longer one by itself.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["raw_id"].to_numpy(), batch["record"].tolist()
            block = np.cumsum([len(t or "") for t in texts]) // BLOCK_BYTES
            edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(edges, edges[1:], strict=False):
                rows = Flattening(kinds, values).run(texts[a:b])
                if len(rows):
                    yield rows.assign(raw_id=keys[a + rows["record"].to_numpy(np.int64)])[["raw_id", "child", "parent_pos", "pos", "value"]]

    return spread(records.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("raw_id"), F.col(text).alias("record"))).mapInPandas(run, CHILD_SCHEMA)


def child_table(children: DataFrame, child: str, fields: dict[str, str]) -> DataFrame:
    """One flat table: the children of a kind with columns read from their JSON text (name -> JSON path)."""
    # a cell may be a bare text instead of an object with a text
    plain = F.when(F.col("value").startswith('"'), F.get_json_object(F.concat(F.lit('{"text":'), F.col("value"), F.lit("}")), "$.text"))
    cols = [(F.coalesce(F.get_json_object("value", path), plain) if path == "$.text" else F.get_json_object("value", path)).alias(name) for name, path in fields.items()]
    return children.where(F.col("child") == child).select("raw_id", "parent_pos", "pos", *cols)
