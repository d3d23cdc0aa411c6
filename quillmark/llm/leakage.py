"""Evaluation texts inside training text, by a generalised suffix automaton (problem 6).

The normalised questions and answers of the test items form two automata, one over words and one over characters (for
Chinese items). Every document streams through them: the current state keeps the longest stretch of test text that ends at
the token, and where that stretch reaches the least length, the state of its shortest reportable suffix names all test
items that hold it. Words are runs of letters and digits; case, width, punctuation, spacing and line breaks don't count.

Defined results: null, empty and short texts leak nothing; test items with a null id or without text are skipped; equal
passages in several test items give a row each; documents with the same id are reported once. The test items are the
stated query set: they are read in blocks of about BLOCK items, each broadcast by itself and made an automaton once per
Python worker, against all documents.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut_lineage
from quillmark.sources.tables import spread

WORD = re.compile(r"[^\W_]+")
IDEOGRAPH = re.compile("[㐀-䶿一-鿿豈-﫿]")
LEAST_WORDS, LEAST_CHARS, BLOCK = 12, 24, 20_000
LEAK_SCHEMA = "doc_id bigint, case_id string, longest int, covered double"


def normal(text: str) -> str:
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def is_chinese(text: str) -> bool:
    """Whether ideographs make up at least a third of the letters and digits."""
    letters = "".join(WORD.findall(normal(text)))
    return len(IDEOGRAPH.findall(letters)) * 3 >= max(1, len(letters))


class SuffixAutomaton:
    """Suffix automaton of several token strings, joined by separators that no text holds."""

    def __init__(self, strings: list[tuple[str, list]], least: int):
        self.least, self.next, self.link, self.length = least, [{}], [-1], [0]
        last = 0
        for n, (_, tokens) in enumerate(strings):
            for token in [*tokens, ("end", n)]:
                last = self._extend(last, token)
        #: state -> (test item, share of its text that one passage of least tokens is)
        self.owners: list[set[str] | None] = [None] * len(self.next)
        for owner, tokens in strings:
            state = 0
            for token in tokens:
                state = self.next[state][token]
                s = state
                while s > 0 and self.length[s] >= least and owner not in (self.owners[s] or ()):
                    self.owners[s] = (self.owners[s] or set()) | {owner}
                    s = self.link[s]
        self.sizes: dict[str, int] = {}
        for owner, tokens in strings:
            self.sizes[owner] = max(self.sizes.get(owner, 0), len(tokens))
        self.known = {t for t in self.next[0] if not isinstance(t, tuple)}

    def _extend(self, last: int, token) -> int:
        nxt, link, length = self.next, self.link, self.length
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and token not in nxt[p]:
            nxt[p][token] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][token]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(token) == q:
                    nxt[p][token] = clone
                    p = link[p]
                link[q] = link[state] = clone
        return state

    def matches(self, tokens) -> Iterator[tuple[int, int, set[str]]]:
        """(end position, longest matching length, test items) wherever the length reaches ``least``."""
        nxt, link, length, least, known, root = self.next, self.link, self.length, self.least, self.known, self.next[0]
        state = size = 0
        for at, token in enumerate(tokens):
            if token not in known:
                state = size = 0
                continue
            go = nxt[state].get(token)
            while go is None and state:
                state = link[state]
                size = length[state]
                go = nxt[state].get(token)
            state, size = (go, size + 1) if go is not None else (root[token], 1)
            if size >= least:
                s = state
                while length[link[s]] >= least:
                    s = link[s]
                yield at, size, self.owners[s] or set()


def automata(cases: list[tuple[str, str]]) -> tuple[SuffixAutomaton | None, SuffixAutomaton | None, bool]:
    """The automata over words and characters, and whether every reportable Chinese passage holds an ideograph."""
    words, chars = [], []
    for owner, text in cases:
        tokens = WORD.findall(normal(text))
        if is_chinese(text):
            chars.append((owner, list("".join(tokens))))
        else:
            words.append((owner, tokens))
    windows = ("".join(t[i : i + LEAST_CHARS]) for _, t in chars for i in range(len(t) - LEAST_CHARS + 1))
    marked = all(IDEOGRAPH.search(w) for w in windows)
    return (SuffixAutomaton(words, LEAST_WORDS) if words else None, SuffixAutomaton(chars, LEAST_CHARS) if chars else None, marked)


def leaks_in(text: str, words, chars, marked: bool) -> dict[str, tuple[int, int]]:
    """test item -> (longest match, tokens of the item's longer text) of one document."""
    tokens = WORD.findall(normal(text))
    found: dict[str, tuple[int, int]] = {}
    streams = [(words, tokens)] if words is not None else []
    if chars is not None and (not marked or IDEOGRAPH.search(text) or not text.isascii() and IDEOGRAPH.search(normal(text))):
        streams.append((chars, "".join(tokens)))
    for automaton, stream in streams:
        for _, size, owners in automaton.matches(stream):
            for owner in owners:
                if size > found.get(owner, (0, 0))[0]:
                    found[owner] = (size, automaton.sizes[owner])
    return found


def case_blocks(cases: DataFrame) -> Iterator:
    """The texts of the test items in broadcast blocks of about BLOCK items, one at a time on the driver."""
    texts = cases.where("id is not null").select("id", F.explode(F.array("question", "expected_answer")).alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-texts.count() // (2 * BLOCK)))
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
        yield cases.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted((r.id, r.text) for r in own.collect())))


_built: dict[str, tuple] = {}


def built(shared) -> tuple:
    """The automata of a block, built once per Python worker; only the last blocks are kept."""
    name, rows = shared.value
    if name not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = automata(rows)
    return _built[name]


def leaked_cases(documents: DataFrame, cases: DataFrame) -> DataFrame:
    """LEAK_SCHEMA: one row per document and test item of which it holds a passage.

    ``longest`` is the longest matching stretch in words (characters for Chinese items), ``covered`` its share of the
    item's longer text. Documents are read once per block, without a shuffle of texts.
    """
    texts = spread(documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    out = None
    for shared in case_blocks(cases):

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            words, chars, marked = built(shared)
            for batch in batches:
                hits = [(d, c, n, min(1.0, n / size)) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for c, (n, size) in leaks_in(t, words, chars, marked).items()]
                yield pd.DataFrame(hits, columns=["doc_id", "case_id", "longest", "covered"])

        part = texts.mapInPandas(run, LEAK_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "case_id").agg(F.max("longest").alias("longest"), F.max("covered").alias("covered"))


@cache
def joins_before(c: str) -> bool:
    """Whether normalising may join a character with the one before it: marks and the later parts of Hangul syllables."""
    first = unicodedata.normalize("NFKD", c)[0]
    return unicodedata.category(first)[0] == "M" or "\u1160" <= first <= "\u11ff"


def normal_places(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The normal form of text, and for each of its characters the span of text it comes from."""
    letters, places = [], []
    edges = [i for i, c in enumerate(text) if i == 0 or not joins_before(c)]
    for a, b in zip(edges, [*edges[1:], len(text)], strict=True):
        own = normal(text[a:b])
        letters.append(own)
        places += [(a, b)] * len(own)
    return "".join(letters), places


def spans_of(text: str, words, chars, marked: bool) -> list[tuple[int, int]]:
    """The character spans of text that repeat test text, merged."""
    flat, back = normal_places(text)
    tokens = [(m.start(), m.end()) for m in WORD.finditer(flat)]
    spots: list[tuple[int, int]] = []
    if words is not None:
        for at, size, _ in words.matches([flat[a:b] for a, b in tokens]):
            spots.append((back[tokens[at - size + 1][0]][0], back[tokens[at][1] - 1][1]))
    if chars is not None and (not marked or IDEOGRAPH.search(flat)):
        places = [p for a, b in tokens for p in range(a, b)]
        for at, size, _ in chars.matches([flat[p] for p in places]):
            spots.append((back[places[at - size + 1]][0], back[places[at]][1]))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def cut_out(text: str, words, chars, marked: bool) -> tuple[int, int, str]:
    """(spans, characters removed, rest) of a text; what a cut brings together is looked at again."""
    n = removed = 0
    while leaks_in(text, words, chars, marked):
        spans = spans_of(text, words, chars, marked) or [(0, len(text))]
        n, removed = n + len(spans), removed + sum(b - a for a, b in spans)
        edges = [0, *[x for s in spans for x in s], len(text)]
        parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
        text = parts[0]
        for part in parts[1:]:  # a blank keeps the words on both sides of a cut apart
            text += " " + part if text[-1:].isalnum() and part[:1].isalnum() else part
    return n, removed, text


def without_leaks(documents: DataFrame, cases: DataFrame, most_covered: float = 0.5) -> DataFrame:
    """The leaking documents cleaned: doc_id, n_spans, removed (characters), kept_text.

    Spans of at least the least length are cut out until none is left; a document of which they cover more than
    ``most_covered`` goes whole (kept_text null). Documents without leaks are not among the rows. Each block of test items
    cuts what the blocks before it left; with several blocks this is repeated on the cut documents until nothing changes.
    """
    schema = "doc_id bigint, size int, n_spans int, removed int, kept_text string"
    blocks = list(case_blocks(cases))

    def cut(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = built(shared)
            for batch in batches:
                done = [cut_out(t, *model) for t in batch["kept_text"]]
                yield batch.assign(n_spans=batch["n_spans"] + [d[0] for d in done], removed=batch["removed"] + [d[1] for d in done], kept_text=[d[2] for d in done])

        return rows.mapInPandas(run, schema)

    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").alias("size"), F.lit(0).alias("n_spans"), F.lit(0).alias("removed"), F.col("text").alias("kept_text"))
    def cut_all(rows: DataFrame) -> DataFrame:
        for n, shared in enumerate(blocks, 1):
            rows = cut(rows, shared)
            if n % 4 == 0:
                rows = cut_lineage(rows)
        return rows

    rows = cut_all(spread(texts)).where("n_spans > 0")
    while len(blocks) > 1:
        before = cut_lineage(rows)
        rows = cut_lineage(cut_all(before))
        if rows.agg(F.sum("n_spans")).first()[0] == before.agg(F.sum("n_spans")).first()[0]:
            break
    whole = F.col("removed") > most_covered * F.col("size")
    return rows.select("doc_id", "n_spans", "removed", F.when(~whole, F.col("kept_text")).alias("kept_text"))
