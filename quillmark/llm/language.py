"""Languages of texts and of their parts, by prediction by partial matching (problem 4).

Per language, a byte context tree of order ORDER holds counts of each byte after each context, frozen after training; the
code length of a byte is taken at its longest known context, and each shorter context passed on the way adds its escape
probability (method C). Contexts begin at a word (for ideographs and kana: at the character before), so that the exact code
length of a sentence is the sum over its words, and each distinct word is scored once per task. A sentence goes to the
language with the shortest code; adjacent sentences of one language form segments.

Training: at most about SAMPLE distinct labelled texts per language (chosen by hash, so alike at every size), counted per language on the
executors; sentences whose words vote for another language (mislabelled or mixed rows) are left out of the trees.

Defined results: null, empty and letterless texts have no segment; null, blank and unknown labels name no language; a
language without labelled rows is never assigned; equal code lengths go to the first language of LANGUAGES; re-delivered
records count once, by their earliest row; other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut_lineage
from quillmark.sources.tables import earliest, spread

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "ja")
ORDER, SAMPLE, LEAST_LETTERS, SURE_BITS, MOST_WORDS = 4, 1500, 40, 10.0, 500_000
# fixed values: codes and names of the languages
NAMES = {
    "en": "en eng english anglais englisch inglés inglês 英语 英文 英語",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 漢語 国语 國語 普通话 普通話 简体中文 繁體中文 chinois chinesisch",
    "de": "de deu ger german deutsch allemand alemán alemão 德语 德文 ドイツ語",
    "fr": "fr fra fre french français francais französisch francés francês 法语 法文 フランス語",
    "es": "es spa spanish español espanol castellano castilian espagnol spanisch espanhol 西班牙语 スペイン語",
    "pt": "pt por portuguese português portugues portugais portugiesisch portugués 葡萄牙语 ポルトガル語",
    "ja": "ja jpn japanese 日本語 日语 日文 japonais japanisch japonés japonês",
}
CODES = {name: lang for lang, names in NAMES.items() for name in names.split()}
SEGMENT_TYPE = "array<struct<lang:string,start:int,stop:int,letters:int,confidence:double>>"

SIGN = "぀-ヿ㐀-䶿一-鿿豈-﫿々"
TOKEN = re.compile(f"[{SIGN}]+|[^\\W\\d_{SIGN}]+")
FIRST_SIGN = re.compile(f"[{SIGN}]")
END = re.compile(
    r"(?:[.!?…]+[\"'”’»)\]」』]*(?=\s|[「『“«《]|[" + SIGN + r"]))\s*|[。！？]+[”’」』）]*\s*|\n\s*\n\s*|(?<=[^\s" + SIGN + r",;\-])\n(?=[^\Wa-zß-öø-ÿ_])|\n(?=[-*•|#>])|(?<=[|:：])\n"
)
QUOTED = re.compile(r"「[^「」\n]*」|『[^『』\n]*』|《[^《》\n]*》|“[^“”\n]*”|«[^«»\n]*»|„[^„“”\n]*[“”]|\"[^\"\n]*\"")


def named_language(label: Column) -> Column:
    """The language a label names in any code, name or regional form; null where it names none."""
    clean = F.lower(F.trim(F.regexp_replace(label, r"[\s 　]+", " ")))
    names = F.create_map(*[F.lit(x) for pair in sorted(CODES.items()) for x in pair])
    head = F.regexp_extract(clean, r"^([^\s\-_(（,/.;]+)", 1)
    return F.coalesce(names[clean], names[head])


def tokens_of(text: str) -> list[str]:
    """The words of a text in lower case; a run of ideographs and kana gives each sign with the sign before it."""
    out: list[str] = []
    for run in TOKEN.findall(text.lower()):
        if FIRST_SIGN.match(run):
            out += map("".join, zip("\t" + run, run, strict=False))
        else:
            out.append(run)
    return out


def steps(token: str) -> Iterator[tuple[bytes, int]]:
    """(context, byte) of each byte that a token pays for."""
    if len(token) == 2 and FIRST_SIGN.match(token[1]):
        before, own = token[0].encode(), token[1].encode()
    else:
        before, own = b" ", (token + " ").encode("utf-8", "replace")
    text = before + own
    return ((text[max(0, i - ORDER) : i], text[i]) for i in range(len(before), len(text)))


def count_contexts(words: Counter) -> dict[bytes, dict[int, int]]:
    """The context tree of one language: counts of the next byte after each context of up to ORDER bytes."""
    tree: dict[bytes, dict[int, int]] = {}
    for token, n in words.items():
        for context, byte in steps(token):
            for k in range(len(context) + 1):
                node = tree.setdefault(context[k:], {})
                node[byte] = node.get(byte, 0) + n
    return tree


class Coder:
    """Exact code lengths of words under the frozen trees of all languages."""

    def __init__(self, trees: dict[str, dict[bytes, dict[int, int]]]):
        self.languages = [lang for lang in LANGUAGES if lang in trees]
        self.trees = [trees[lang] for lang in self.languages]
        self.sums = [{c: (sum(n.values()), len(n)) for c, n in t.items()} for t in self.trees]
        self.known: dict[tuple[bytes, int], np.ndarray] = {}
        self.row: dict[str, int] = {}
        self.costs = np.zeros((1 << 12, len(self.languages)), np.float32)

    def byte(self, context: bytes, byte: int) -> np.ndarray:
        found = self.known.get((context, byte))
        if found is None:
            shorter = self.byte(context[1:], byte) if context else np.full(len(self.trees), 8.0, np.float32)
            found = shorter.copy()
            for i, (tree, sums) in enumerate(zip(self.trees, self.sums, strict=True)):
                node = tree.get(context)
                if node is not None:
                    total, distinct = sums[context]
                    own = node.get(byte)
                    found[i] = log2((total + distinct) / own) if own else shorter[i] + log2((total + distinct) / distinct)
            self.known[context, byte] = found
        return found

    def number(self, token: str) -> int:
        """The row of a word's code lengths in ``costs``."""
        n = self.row.get(token)
        if n is None:
            n = self.row[token] = len(self.row)
            if n >= len(self.costs):
                self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
            self.costs[n] = sum(self.byte(c, b) for c, b in steps(token))
        return n

    def lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths (texts x languages) and letters of each text."""
        if len(self.row) > MOST_WORDS:  # the words of other texts; they are scored again where they return
            self.row, self.known, self.costs = {}, {}, np.zeros_like(self.costs[: 1 << 12])
        ids: list[int] = []
        starts, letters = [], []
        row, number = self.row, self.number
        for text in texts:
            own = tokens_of(text)
            starts.append(len(ids))
            letters.append(sum(1 if len(t) == 2 and FIRST_SIGN.match(t[1]) else len(t) for t in own) if not text.isascii() else sum(map(len, own)))
            ids += [row[t] if t in row else number(t) for t in own]
        cost = np.zeros((len(texts), len(self.languages)))
        if ids:
            total = np.concatenate([np.zeros((1, len(self.languages))), np.cumsum(self.costs[np.array(ids)], axis=0, dtype=np.float64)])
            edge = np.array([*starts, len(ids)])
            cost = total[edge[1:]] - total[edge[:-1]]
        return cost, np.array(letters, np.int64)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text."""
    out, last = [], 0
    for m in END.finditer(text):
        if m.end() > last:
            out.append((last, m.end()))
            last = m.end()
    if last < len(text):
        out.append((last, len(text)))
    return out


def without_quotes(sentence: str) -> str:
    """The sentence without names and titles quoted in it, unless nothing else is there."""
    if not QUOTED.search(sentence):
        return sentence
    rest = QUOTED.sub(" ", sentence)
    return rest if TOKEN.search(rest) else sentence


def segments_of(texts: list[str], coder: Coder) -> list[list[tuple[str, int, int, int, float]]]:
    """(language, start, stop, letters, confidence) of the segments of each text."""
    spans = [sentences(t) for t in texts]
    cost, letters = coder.lengths([without_quotes(t[a:b]) for t, own in zip(texts, spans, strict=True) for a, b in own])
    names, out, at = coder.languages, [], 0
    if not names:
        return [[] for _ in texts]
    best = cost.argmin(axis=1) if len(cost) else np.zeros(0, int)
    lead = np.partition(cost, 1, axis=1)[:, 1] - cost.min(axis=1) if len(names) > 1 and len(cost) else np.full(len(cost), 99.0)
    best_list, lead_list, letter_list = best.tolist(), lead.tolist(), letters.tolist()
    for own in spans:
        runs: list[list] = []  # language, start, stop, letters, code lengths
        pending = None
        for n, (a, b) in enumerate(own, at):
            if not letter_list[n]:
                continue
            lang = best_list[n]
            if runs and (lang == runs[-1][0] or cost[n, runs[-1][0]] - cost[n, lang] < SURE_BITS):
                runs[-1][2] = b
                runs[-1][3] += letter_list[n]
                runs[-1][4] = runs[-1][4] + cost[n]
            elif not runs and lead_list[n] < SURE_BITS:
                # too little to tell: it goes with the sentence after it
                pending = [None, a, b, letter_list[n] + (pending[3] if pending else 0), cost[n] + (pending[4] if pending else 0)]
            else:
                runs.append([lang, a, b, letter_list[n], cost[n]])
                if pending and pending[4][lang] - pending[4].min() < SURE_BITS:
                    runs[-1] = [lang, pending[1], b, letter_list[n] + pending[3], cost[n] + pending[4]]
                pending = None
        if pending and not runs:
            runs = [[int(pending[4].argmin()), *pending[1:]]]
        at += len(own)
        merged: list[list] = []
        for run in runs:
            if run[3] < LEAST_LETTERS:
                continue
            if merged and merged[-1][0] == run[0]:
                merged[-1] = [run[0], merged[-1][1], run[2], merged[-1][3] + run[3], merged[-1][4] + run[4]]
            else:
                merged.append(run)
        out.append([(names[lang], a, b, n, float(1 / np.exp2(np.maximum(c.min() - c, -60.0)).sum())) for lang, a, b, n, c in merged])
    return out


def training_rows(labelled: DataFrame) -> DataFrame:
    """At most about SAMPLE distinct texts per language of ``labelled`` (lang, text), chosen by a hash of the text."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).collect()}
    if not counts:
        return labelled
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, SAMPLE / n))])[F.col("lang")]
    # copies of a text are chosen together and combined before the shuffle
    return labelled.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).distinct()


def word_votes(counts: dict[str, Counter]) -> dict[str, dict[str, float]]:
    """word -> share of each language in it, each language's words counted as parts of its own total."""
    totals = {lang: max(1, sum(c.values())) for lang, c in counts.items()}
    votes: dict[str, dict[str, float]] = {}
    for lang, c in counts.items():
        for word, n in c.items():
            votes.setdefault(word, {})[lang] = n / totals[lang]
    return {w: {lang: x / sum(v.values()) for lang, x in v.items()} for w, v in votes.items()}


def own_words(text: str, lang: str, votes: dict[str, dict[str, float]]) -> list[str]:
    """The words of the sentences of text whose words vote for lang.

    Mislabelled rows and foreign parts of mixed ones lose the vote as long as most rows of each language are labelled
    right, so the trees are counted on clean text.
    """
    out: list[str] = []
    for a, b in sentences(text):
        words = tokens_of(without_quotes(text[a:b]))
        total: dict[str, float] = {}
        for w in words:
            for k, x in votes.get(w, {}).items():
                total[k] = total.get(k, 0.0) + x
        if total and max(sorted(total), key=total.__getitem__) == lang:
            out += words
    return out


def train(labelled: DataFrame) -> dict[str, dict[bytes, dict[int, int]]]:
    """The context trees; counted on the executors, one bounded group of sampled rows per language."""
    sample = cut_lineage(training_rows(labelled))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "data": [pickle.dumps(Counter(t for text in pdf["text"] for t in tokens_of(text)))]})

    counts = {r.lang: pickle.loads(bytes(r.data)) for r in sample.groupBy("lang").applyInPandas(first, "lang string, data binary").collect()}
    shared = sample.sparkSession.sparkContext.broadcast(word_votes(counts))

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        lang = pdf["lang"].iloc[0]
        words = Counter(w for text in pdf["text"] for w in own_words(text, lang, shared.value))
        return pd.DataFrame({"lang": [lang], "data": [pickle.dumps(count_contexts(words))]})

    return {r.lang: pickle.loads(bytes(r.data)) for r in sample.groupBy("lang").applyInPandas(second, "lang string, data binary").collect()}


def text_rows(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Texts of both tables that can be cases: rec_table, source_id, id, ingested_at, label, text."""
    skip = ["table", "equation"]
    a = items.where(~F.coalesce(F.col("item_type").isin(skip), F.lit(False))).select(F.lit("package_items").alias("rec_table"), "source_id", F.col("item_id").alias("id"), "ingested_at", F.col("lang").alias("label"), F.col("raw_text").alias("text"))
    b = chunks.where(~F.coalesce(F.get("modalities", 0).isin(skip), F.lit(False))).select(F.lit("chunks").alias("rec_table"), "source_id", F.col("chunk_id").alias("id"), "ingested_at", F.col("lang").alias("label"), "text")
    return a.unionByName(b)


def project_segments(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per record: rec_table, rec_key, label, declared (language named by the label) and its segments."""
    rows = text_rows(items, chunks).where("text is not null and text <> ''")
    labelled = rows.select(named_language(F.col("label")).alias("lang"), "text").where("lang is not null").where(F.length("text") >= LEAST_LETTERS)
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(train(labelled)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(pickle.loads(shared.value))
        for pdf in batches:
            found = segments_of(list(pdf["text"]), coder)
            yield pdf.drop(columns="text").assign(segments=[[{"lang": g, "start": a, "stop": b, "letters": n, "confidence": c} for g, a, b, n, c in own] for own in found])

    schema = f"rec_table string, source_id string, id string, ingested_at timestamp, label string, segments {SEGMENT_TYPE}"
    first = earliest(spread(rows).mapInPandas(run, schema), ["rec_table", "source_id", "id"], ["label", "segments"])
    return first.select("rec_table", F.concat_ws("#", "source_id", "id").alias("rec_key"), "label", named_language(F.col("label")).alias("declared"), "segments")


def label_cases(records: DataFrame) -> DataFrame:
    """Records whose label is missing or wrong and all parts of mixed ones: rec_table, rec_key, seg_no, lang, confidence, start, stop."""
    several = F.size("segments") > 1
    wrong = (F.size("segments") == 1) & ~F.coalesce(F.col("declared") == F.col("segments")[0]["lang"], F.lit(False))
    each = records.where(several | wrong).select("rec_table", "rec_key", several.alias("several"), F.posexplode("segments").alias("n", "s"))
    number = F.when(F.col("several"), F.col("n") + 1).otherwise(F.lit(0)).cast("int")
    return each.select("rec_table", "rec_key", number.alias("seg_no"), "s.lang", "s.confidence", "s.start", "s.stop")
