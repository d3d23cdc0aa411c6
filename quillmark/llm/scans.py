"""Repair of text from scanned pages (problem 1).

The distinct texts are read as words once (broken words joined over line ends; copies of a text and re-deliveries count
once, so a noisy text cannot make its misreadings frequent). Skip-gram vectors with negative sampling are learned from
them: tasks count how often the CONTEXTS commonest words stand near each other, the vectors of these words are trained on
that bounded table by full-batch gradient steps, and a second pass gives every word, however rare, its vector: the sum of
the learned output vectors around it less the expected sum of its negative samples, mapped to the trained space by least
squares. Rare words are linked to the frequent words one plausible glyph edit away, with the cosine of their vectors. At
each occurrence the words around it decide: a linked word is replaced by the candidate of the best log odds in its context,
if nothing speaks against that one, and for words whose vectors differ (a word of its own that is also a misreading) only if
the word itself has no better odds by its other occurrences. Ideographs are judged by the pairs they form with both
neighbours. Then running headers, footers and page numbers are marked (page patterns, and the header and footer items of
the package compared on a glyph skeleton) and removed, broken words joined and lines reflowed into paragraphs.

Defined results: null and empty texts have no rows and keep their value; a text of one line is never furniture; blank lines
are body and end paragraphs; texts without noise come out as they are; of re-delivered records the earliest counts; equal
texts are judged alike within a package; a package without header items still knows its title.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.skew import hot_keys, salted_left_join
from quillmark.session import cut_lineage
from quillmark.sources.tables import earliest, spread

FRAME_TYPES = ["page_header", "page_footer", "page_number"]
KEEP_LINES = ["title", "table", "equation"]  # types whose lines are never running headers
CONTEXTS, DIMENSIONS, WINDOW, NEGATIVE, COMMON, EPOCHS = 1024, 32, 3, 1.0, 1e-3, 50
#: least frequency of the right word, absolute and beside the misread one; least log odds of a candidate in its context;
#: log odds that a rare word is a misreading; cosine from which two words count as one word by their contexts
RATIO, LEAST_COUNT, LEAST_FIT, MISREAD, SAME, SURE_RATIO, PAIR_RATIO = 8, 8, -1.0, 1.0, 0.5, 40, 20.0
#: bounds of what is broadcast, beyond which the same is joined; packages that share a running line which is no title
MOST_LINKS, MOST_KEYS, MOST_WORDS, SHARING = 50_000, 1_000_000, 300_000, 3
#: words that are added up at once in a task
STRETCH = 200_000
EVENT_TYPE = "array<struct<line_no:int,noise:string>>"

# fixed values: misread glyphs and what they stand for
GLYPHS = (
    "c e|l i|f t|0 o|1 l|1 i|ii u|cl d|§ s|q g|rn m|b h|v y|n ri|vv w|m rn|rm nn|5 S|5 s|8 B|U ll|ﬁ fi|ﬂ fl|ﬀ ff|ﬃ ffi|ﬄ ffl|ä a|( c|ö o|ü u|| l|| i|I l|l I|0 O|6 b|9 g|$ s|$ S|€ e|@ a|li h|lc k|ln h|tl d"
    "|u n|n u|e c|t f|i l|h b|y v|g q|j i|O 0|o 0|l 1|I 1|i 1|S 5|s 5|Z 2|z 2|b 6|G 6|B 8|g 9|q 9|T 7|A 4"
)
GLYPH_EDITS = [tuple(x.split(" ")) for x in re.split(r"\|(?=\S+ \S)", GLYPHS)]
SIGN_PAIRS = "由甴 库厍 单単 员贠 入人 已己 已巳 统綂 货贷 责贵 台合 日曰 间问 大太 未末 土士 干千 天夭 处外 设没 折拆 治冶 今令 晴睛 侯候 乌鸟 免兔 午牛 木本 王玉 住往 待侍 申甲 田由 目日 自白 析折 拨拔 既即 形刑 历厉 买卖 问间 困因 子孑 农衣 冷泠 准淮 减城 决快 净静 凭任 部郎 量童 防访 检捡 输愉 据居 果杲 查杳 标枟 的旳 各名 配酏 录求 系糸 类粪 采釆 戶户 ロ口 カ力 ニ二 エ工 タ夕 ハ八 ト卜 リソ シツ"
PAIRS: dict[str, set[str]] = defaultdict(set)
for _a, _b in SIGN_PAIRS.split():
    PAIRS[_a].add(_b)
    PAIRS[_b].add(_a)
CONJUNCTIONS = frozenset("and or und oder bzw et ou y e o u ou to bis".split())

SIGN = "぀-ヿ㐀-䶿一-鿿豈-﫿"
HYPHENS = "-‐‑¬\xad"
WORD = re.compile(f"[^\\W_{SIGN}](?:[^\\W_{SIGN}]|[§$€@|(](?=[^\\W\\d_{SIGN}]))*|[§$€@](?=[^\\W\\d_{SIGN}])[^\\W_{SIGN}]+")
RUN = re.compile(f"[{SIGN}]+")
CONFUSABLE = re.compile("[" + "".join(sorted(PAIRS)) + "]")
CODE = re.compile(r"\d+|[A-Z]{1,3}\d+")
PAGE = re.compile(
    r"[\[({<~\-–—·•*|\s]*(?:(?:page|pagc|paqe|p\.|pp?\.?|pg\.?|seite|seitc|s\.|página|pagina|pág\.|pag\.)\s*)?[\dlIOoSZ]{1,6}(?:\s*(?:/|of|von|sur|de|di|aus)\s*[\dlIOoSZ]{1,6})?[\])}>~\-–—·•*|\s]*", re.I
)
PAGE_SIGNS = re.compile(r"[-–—~·\[(\s]*第?\s*[\dlO]{1,6}\s*[页頁](?:\s*[/,，]?\s*共\s*[\dlO]{1,6}\s*[页頁])?[-–—~·\])\s]*|[-–—\s]*[\dlO]{1,6}\s*ページ[-–—\s]*|(?:ページ|頁|页)\s*[\dlO]{1,6}")
ROMAN = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
NUMBERED = re.compile(r"^\s*\d{1,6}\s*\|\s*|\s*\|\s*\d{1,6}\s*$|\s{2,}\d{1,6}\s*$")
DECIMAL = re.compile(r"(?<![\w.,])(?=[^\s\d]*\d)[\dlIOSZbBGqg]+(?:[.,][\dlIOSZbBGqg]+)+(?![\w])")
LETTERED = re.compile("[lIOSZbBGqg][.,]?\\d|\\d[.,]?[lIOSZbBGqg]")  # what every decimal with a misread digit holds
DIGITS = str.maketrans("lIOSZbBGqg", "1105268699")
SKELETON = str.maketrans({"c": "e", "l": "i", "1": "i", "|": "i", "f": "t", "0": "o", "§": "s", "5": "s", "$": "s", "q": "g", "9": "g", "8": "h", "b": "h", "v": "y", "6": "h", "ä": "a", "ö": "o", "€": "e", "@": "a", "z": "2", "7": "t", "4": "a", "j": "i", "u": "n"})
SPACES = re.compile(r"\s+")


def key(line: str) -> int:
    """A line's hash on its glyph skeleton: misreadings of one line have one key."""
    t = SPACES.sub(" ", line.strip().lower())
    for a, b in (("vv", "w"), ("rn", "m"), ("cl", "d"), ("ii", "u"), ("rm", "nn"), ("ri", "n")):
        t = t.replace(a, b)
    t = "".join(min(PAIRS[c] | {c}) if c in PAIRS else c for c in t.translate(SKELETON))
    return zlib.crc32(t.encode("utf-8", "replace")) | (zlib.adler32(t.encode("utf-8", "replace")) << 32 & 0x7FFFFFFF00000000)


def line_keys(line: str) -> list[int]:
    """Keys under which a line may be known: itself, without its page number, without a year, and after a dash."""
    core = NUMBERED.sub("", line).strip()
    forms = {core}
    forms.add(re.sub(r"\s+\d{1,6}$", "", core))
    for dash in (" — ", " – ", " - ", " | "):
        if dash in core:
            rest = core.split(dash, 1)[1]
            forms |= {rest, re.sub(r"\s+\d{1,6}$", "", rest)}
    return [key(f) for f in forms if len(f) > 2]


def is_page_number(line: str) -> bool:
    t = line.strip()
    if len(t) > 40 or not t:
        return False
    if any(c.isdigit() for c in t):
        return bool(PAGE.fullmatch(t) or PAGE_SIGNS.fullmatch(t)) and not t.endswith(("%", "."))
    return len(t) < 12 and bool(ROMAN.fullmatch(t.strip("-–—~·[]() ")))


def furniture(lines: list[str], keys) -> list[bool]:
    """Which lines are running headers, footers or page numbers."""
    if len(lines) < 2:
        return [False] * len(lines)
    known = len(keys) > 0
    out = []
    for line in lines:
        if not line or line[0] == "#" or line[:2] == "| ":
            out.append(False)
        elif len(line) <= 40 and is_page_number(line):
            out.append(True)
        else:
            out.append(known and line.rstrip()[-1:] not in ".。,，;；" and any(k in keys for k in line_keys(line)))
    return out


def broken(line: str, after: str) -> tuple[str, str] | None:
    """The two parts of a word that line breaks with a hyphen-like mark before the next body line."""
    a, b = line.rstrip(), after.lstrip()
    if len(a) < 2 or a[-1] not in HYPHENS or not (a[-2].isalnum() or a[-2] in "§$€@|(") or not b or not b[0].isalnum():
        return None
    left = re.search(r"[^\W\d_][^\s]*$", a[:-1])
    right = re.match(r"[^\W_]+(?:[§$€@|][^\W_]+)*", b)
    if left is None or right is None or right[0].lower() in CONJUNCTIONS or RUN.match(b) or RUN.match(a[-2]):
        return None
    if not any(c.isalpha() for c in right[0]):
        return None
    head = WORD.findall(left[0])
    return (head[-1], right[0]) if head and left[0].endswith(head[-1]) else None


def layout(text: str, keys, keep: bool) -> tuple[list[str], list[bool], dict[int, tuple[int, str, str]]]:
    """The lines, which are furniture, and broken words: line -> (line of the rest, part, rest)."""
    lines = text.split("\n")
    frame = furniture(lines, () if keep else keys) if not keep else [False] * len(lines)
    body = [i for i, f in enumerate(frame) if not f and lines[i].strip()]
    breaks = {}
    for i, j in zip(body, body[1:], strict=False):
        last = lines[i].rstrip()[-1]
        if last in HYPHENS:
            parts = broken(lines[i], lines[j])
            if parts:
                breaks[i] = (j, *parts)
    return lines, frame, breaks


def spoken(lines: list[str], frame: list[bool], breaks: dict) -> list[str]:
    """The words of the body, broken ones joined."""
    if not breaks and not any(frame):
        return WORD.findall("\n".join(lines))
    parts = []
    for i, line in enumerate(lines):
        if frame[i] or not line:
            continue
        if i in breaks:
            parts.append(line.rstrip()[:-1])
        else:
            parts.append(line + "\n")
    return WORD.findall("".join(parts))


def candidates(word: str) -> set[str]:
    """What a word may be a misreading of: all words one glyph edit away."""
    out = set()
    for wrong, right in GLYPH_EDITS:
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    out.discard(word)
    return out


def is_odd(word: str) -> bool:
    """Whether a word mixes letters with digits or marks in a way that no code does."""
    return not word.isalpha() and not CODE.fullmatch(word) and not re.fullmatch(r"\d+(?:st|nd|rd|th|er|re|e|s|kg|mm|cm|m|ml)?", word)


VECTOR = [f"v{i}" for i in range(DIMENSIONS)]
WORD_SCHEMA = "word string, n bigint, near double, " + ", ".join(f"{v} double" for v in VECTOR)
LINK_SCHEMA = "word string, right string, m bigint, odd boolean, cosine double, near double, own array<double>, fit array<double>"


def spoken_texts(texts: DataFrame) -> DataFrame:
    """words (joined by blanks) and pairs (of signs, joined by line ends) of each distinct text; ``texts``: text, keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words, pairs = [], []
            for text, keep in zip(pdf["text"], pdf["keep"], strict=True):
                words.append(" ".join(spoken(*layout(text, (), keep))))
                own = []
                if not text.isascii():
                    flat = text.replace("\n", "")
                    for m in CONFUSABLE.finditer(flat):
                        i = m.start()
                        own += [flat[i - 1 : i + 1], flat[i : i + 2]] if i else [flat[:2]]
                pairs.append("\n".join(own))
            yield pd.DataFrame({"words": words, "pairs": pairs})

    return texts.groupBy("text").agg(F.min("keep").alias("keep")).mapInPandas(run, "words string, pairs string")


def coded(words: pd.Series) -> tuple[np.ndarray, list[str]]:
    """The words of some texts one after another as numbers, WINDOW gaps after each text; and the words of the numbers.

    A gap is a line end or the empty word.
    """
    gap = " " + "\n " * WINDOW
    codes, known = pd.factorize(np.array((gap.join(words) + gap).split(" "), object))
    return codes, list(known)


def neighbour_counts(spoken: DataFrame, contexts: list[str]) -> np.ndarray:
    """How often each context word stands within WINDOW words of each other one.

    A task adds up a table of the context words, which is bounded however much text there is; its rows are added up by
    context word.
    """
    k = len(contexts)
    shared = spoken.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(contexts)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(k * k, np.int64)
        for pdf in batches:
            codes, known = coded(pdf["words"])
            at = np.array([shared.value.get(w, k) for w in known], np.int64)[codes]
            for step in range(1, WINDOW + 1):
                a, b = at[step:], at[:-step]
                both = (a < k) & (b < k)
                counts += np.bincount(a[both] * k + b[both], minlength=k * k)
        counts = counts.reshape(k, k)
        counts = counts + counts.T
        there = np.flatnonzero(counts.any(axis=1))
        yield pd.DataFrame({"at": there, "counts": [counts[i].tobytes() for i in there]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "counts": [sum(np.frombuffer(c, np.int64) for c in pdf["counts"]).tobytes()]})

    out = np.zeros((k, k))
    for r in spoken.mapInPandas(run, "at int, counts binary").groupBy("at").applyInPandas(add, "at int, counts binary").collect():
        out[r["at"]] = np.frombuffer(bytes(r["counts"]), np.int64)
    return out


def train_vectors(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(input, output) vectors of the context words: skip-gram with NEGATIVE negative samples, in full-batch steps.

    The table holds all positive pairs, so the expectation over negative samples is exact; steps are scaled as in Adagrad.
    """
    rng = np.random.default_rng(7)
    n = len(counts)
    own, out = (rng.normal(0, 0.3, (n, DIMENSIONS)).astype(np.float32) for _ in range(2))
    share = counts.sum(axis=0) / max(1.0, counts.sum())
    positive, negative = counts.astype(np.float32), (NEGATIVE * np.outer(counts.sum(axis=1), share)).astype(np.float32)
    past = [np.full(own.shape, 1e-8, np.float32), np.full(out.shape, 1e-8, np.float32)]
    for _ in range(EPOCHS):
        likely = 1 / (1 + np.exp(-(own @ out.T)))
        pull = positive * (1 - likely) - negative * likely
        steps = pull @ out, pull.T @ own
        for vectors, step, seen in zip((own, out), steps, past, strict=True):
            seen += step**2
            vectors += 0.2 * step / np.sqrt(seen)
    return own.astype(float), out.astype(float)


def word_sums(spoken: DataFrame, contexts: list[str], table: np.ndarray, kept: np.ndarray) -> DataFrame:
    """WORD_SCHEMA: the count of each word and the sums of ``table`` and ``kept`` (per context word) around it.

    Each task adds up its own texts, so the shuffle carries a row per task and distinct word; a task that meets more than
    MOST_WORDS of them passes its sums on and starts anew.
    """
    k = len(contexts)
    shared = spoken.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(contexts)}, np.vstack([np.column_stack([kept, table]), np.zeros((1, DIMENSIONS + 1))]).astype(np.float32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context, rows = shared.value
        number: dict[str, int] = {}
        count, total = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS + 1))

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(total, columns=["near", *VECTOR])
            out.insert(0, "n", count)
            out.insert(0, "word", pd.Series(list(number), dtype=object))
            return out

        for pdf in batches:
            codes, known = coded(pdf["words"])
            at = np.array([-1 if w in ("\n", "") else number.setdefault(w, len(number)) for w in known], np.int64)[codes]
            row = np.array([context.get(w, k) for w in known], np.int64)[codes]
            size = len(number)
            count = np.concatenate([count, np.zeros(size - len(count), np.int64)])
            total = np.concatenate([total, np.zeros((size - len(total), DIMENSIONS + 1))])
            for start in range(0, len(at), STRETCH):  # with the words beside each stretch, so that it may be cut anywhere
                lo, stop = max(0, start - WINDOW), min(len(at), start + STRETCH)
                near = row[lo : stop + WINDOW]
                around = np.zeros((len(near), DIMENSIONS + 1), np.float32)
                for step in range(1, WINDOW + 1):
                    around[step:] += rows[near[:-step]]
                    around[:-step] += rows[near[step:]]
                own = at[start:stop]
                real = np.flatnonzero(own >= 0)
                order = real[np.argsort(own[real], kind="stable")]
                if len(order):
                    first = np.flatnonzero(np.r_[True, own[order][1:] != own[order][:-1]])
                    total[own[order][first]] += np.add.reduceat(around[start - lo :][order], first, axis=0)
                    count += np.bincount(own[real], minlength=size)
            if size > MOST_WORDS:  # a sum may come in parts
                yield frame()
                number, count, total = {}, np.zeros(0, np.int64), np.zeros((0, DIMENSIONS + 1))
        if number:
            yield frame()

    return spoken.mapInPandas(run, WORD_SCHEMA).groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(v).alias(v) for v in ("near", *VECTOR)])


class Space:
    """The trained space: what each context word adds to the sums of a word, and the map from mean sums to vectors."""

    def __init__(self, contexts: list[str], table: np.ndarray, kept: np.ndarray, turn: np.ndarray):
        self.number, self.table, self.kept, self.turn = {w: i for i, w in enumerate(contexts)}, table, kept, turn

    def around(self, words: list[str], at: int) -> tuple[np.ndarray, float]:
        """The sums of the words around one place."""
        near = [self.number[w] for w in (*words[max(0, at - WINDOW) : at], *words[at + 1 : at + 1 + WINDOW]) if w in self.number]
        return (self.table[near].sum(axis=0), float(self.kept[near].sum())) if near else (np.zeros(DIMENSIONS), 0.0)

    def vector(self, sums: np.ndarray, near: float) -> np.ndarray:
        """The vector of a word with these sums; that of few contexts is drawn towards the mean."""
        return sums @ self.turn / (near + 1.0)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(a @ a) * float(b @ b)
    return float(a @ b) / size**0.5 if size > 1e-12 else 0.0


def learn(spoken: DataFrame) -> tuple[DataFrame, Space]:
    """(WORD_SCHEMA of all words, the trained space) of spoken texts."""
    counts = spoken.select(F.explode(F.split("words", " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    commonest = counts.where(F.col("n") >= LEAST_COUNT).orderBy(F.desc("n"), "word").limit(CONTEXTS).collect()
    contexts = [r.word for r in commonest]
    every = max(1, spoken.agg(F.sum(F.size(F.split("words", " ")))).first()[0] or 1)
    kept = np.minimum(1.0, np.sqrt(COMMON * every / np.array([r.n for r in commonest], float)))  # frequent words subsampled
    near = neighbour_counts(spoken, contexts) * np.outer(kept, kept)
    own, out = train_vectors(near)
    share = near.sum(axis=0) / max(1e-9, near.sum())
    table = kept[:, None] * (out - NEGATIVE * (share @ out))
    vocabulary = cut_lineage(word_sums(spoken, contexts, table, kept))
    # the map from sums to trained vectors, by least squares over the context words
    known = {r.word: np.array(r[3:], float) / (r.near + 1.0) for r in vocabulary.join(F.broadcast(spoken.sparkSession.createDataFrame([(w,) for w in contexts], "word string")), "word", "left_semi").collect()}
    weight = np.sqrt([r.n for r in commonest])[:, None]
    sums = np.array([known[w] for w in contexts]).reshape(-1, DIMENSIONS) * weight
    square = sums.T @ sums
    turn = np.linalg.solve(square + (1e-3 * np.trace(square) / DIMENSIONS + 1e-9) * np.eye(DIMENSIONS), sums.T @ (own * weight))
    return vocabulary, Space(contexts, table, kept, turn)


def links(vocabulary: DataFrame, space: Space) -> DataFrame:
    """LINK_SCHEMA: rare words and the frequent words each may be a misreading of.

    A candidate is one glyph edit away and RATIO times as frequent; words that mix letters and digits only need one at
    least as frequent. ``cosine`` is that of the two vectors, ``near`` and ``own`` are the sums of the word, ``fit`` is the
    vector of the right one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, n, c, is_odd(w)) for w, n in zip(pdf["word"], pdf["n"], strict=True) for c in candidates(w)]
            yield pd.DataFrame(rows, columns=["word", "n", "right", "odd"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own, right = (np.array(pdf[c].tolist(), float).reshape(-1, DIMENSIONS) for c in ("a", "b"))
            a, b = own @ space.turn, right @ space.turn / (pdf["right_near"].to_numpy(float)[:, None] + 1.0)
            same = (a * b).sum(axis=1) / np.maximum(np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1), 1e-9)
            yield pdf[["word", "right", "m", "odd"]].assign(cosine=same, near=pdf["near"], own=list(own), fit=list(b))

    words = vocabulary.where(~F.col("word").rlike(f"[{SIGN}]"))
    vectors = words.select("word", "n", "near", F.array(*VECTOR).alias("vector"))
    pairs = words.where(F.length("word") > 1).select("word", "n").mapInPandas(run, "word string, n bigint, right string, odd boolean")
    known = pairs.join(vectors.select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("near").alias("right_near"), F.col("vector").alias("b")), "right")
    common = (F.col("m") >= F.col("n") * RATIO) & (F.col("m") >= LEAST_COUNT) & (F.length("word") > 2)
    # a well-formed code may stand for another code or a number only if it is all but unique
    code = F.col("word").rlike("^[A-Z]{1,3}[0-9]+$")
    known = known.where(F.when(code, F.col("right").rlike("^[A-Z]{0,3}[0-9]+$") & (F.col("m") >= F.col("n") * SURE_RATIO)).otherwise(common | F.col("odd") & (F.col("m") >= F.col("n"))))
    both = known.withColumn("odd", F.col("odd") | code).join(vectors.select("word", "near", F.col("vector").alias("a")), "word")
    return both.select("word", "right", "m", "odd", "near", "right_near", "a", "b").mapInPandas(judge, LINK_SCHEMA)


def shape_right(word: str) -> str | None:
    """A number or code with one letter in place of a digit, as it must have been."""
    if any(c.isdigit() for c in word) and is_odd(word):
        for c in sorted(candidates(word)):
            if CODE.fullmatch(c):
                return c
    return None


class Link:
    """What a word may be a misreading of: the candidates, and the sums of the word itself."""

    def __init__(self, rows: list[tuple]):
        """rows: (right, m, odd, cosine, near, own, fit) of one word."""
        self.rows = sorted([(*r[:6], np.asarray(r[6], float)) for r in rows], key=lambda r: (-r[1], r[0]))
        self.odd, self.near, self.own = rows[0][2], rows[0][4], np.asarray(rows[0][5], float)

    def right(self, space: Space, words: list[str], at: int) -> str | None:
        """The word that must have stood at a place; None where this one may stand as it is."""
        if self.odd:  # no word by its shape: the commonest candidate
            return self.rows[0][0]
        around, near = space.around(words, at)
        # what the word's other occurrences say of it
        other, rest = self.own - around, self.near - near
        alone = rest < 1e-3
        mine = float(around @ space.vector(other, max(0.0, rest)))
        best, score = None, LEAST_FIT
        for word, _, _, same, _, _, fit in self.rows:
            odds = float(around @ fit)
            if odds > score and (same >= SAME or alone or odds + MISREAD > mine):
                best, score = word, odds
        return best


class Reader:
    """Reads texts with the learned links; see the module."""

    def __init__(self, right: dict[str, Link], pairs: dict[str, int], space: Space):
        self.right, self.pairs, self.space = right, pairs, space
        self.plain: set[str] = set()  # words that are right by their shape, as far as seen

    def suspect(self, words: list[str]) -> bool:
        """Whether any of some words has a link or a shape that no word has."""
        if not self.plain.issuperset(words):
            if len(self.plain) > MOST_WORDS:
                self.plain = set()
            odd = [w for w in words if w not in self.plain and not w.isalpha() and shape_right(w)]
            self.plain.update(words)
            self.plain.difference_update(odd)
            if odd:
                return True
        return not self.right.keys().isdisjoint(words)

    def word(self, w: str, words: list[str], at: int) -> str | None:
        """What stands for a word at its place among the words of the body."""
        link = self.right.get(w)
        found = link.right(self.space, words, at) if link is not None else None
        return found if found is not None or w.isalpha() else shape_right(w)

    def signs(self, line: str, before: str, after: str) -> list[tuple[int, str]]:
        """(position, right sign) of misread ideographs; before and after are the signs around the line."""
        out = []
        text = before + line + after
        pairs = self.pairs
        for m in CONFUSABLE.finditer(text):
            i = m.start()
            if not len(before) <= i < len(before) + len(line):
                continue
            c, a, b = text[i], text[i - 1 : i], text[i + 1 : i + 2]
            own = (pairs.get(a + c, 0) + 0.5 if a else 1.0) * (pairs.get(c + b, 0) + 0.5 if b else 1.0)
            best, score = None, own * PAIR_RATIO
            for other in PAIRS[c]:
                s = (pairs.get(a + other, 0) + 0.5 if a else 1.0) * (pairs.get(other + b, 0) + 0.5 if b else 1.0)
                if s > score:
                    best, score = other, s
            if best:
                out.append((i - len(before), best))
        return out

    def read(self, text: str, keys, keep: bool, repair: bool) -> tuple[list[tuple[int, str]], str | None]:
        """(events, repaired text) of one text."""
        lines, frame, breaks = layout(text, keys, keep)
        events: list[tuple[int, str]] = [(i + 1, "furniture") for i, f in enumerate(frame) if f]
        events += [(i + 1, "hyphen") for i in breaks]
        wrong: set[int] = set()
        fixed = list(lines)
        rests = {j: i for i, (j, _, _) in breaks.items()}
        plain = text.isascii() or not CONFUSABLE.search(text)
        numbers = LETTERED.search(text) is not None and any(not m.replace(".", "").replace(",", "").isdigit() for m in DECIMAL.findall(text))
        body = [i for i, f in enumerate(frame) if not f and lines[i]]
        # the words of the body in order, broken ones whole; where a word stands: (line, start, end)
        words: list[str] = []
        spots: list[tuple[int, int, int]] = []
        if self.suspect(WORD.findall(text)) or breaks and self.suspect([a + b for _, a, b in breaks.values()]):
            for i in body:
                own = [(m[0], m.start(), m.end()) for m in WORD.finditer(lines[i])]
                for n, (w, a, b) in enumerate(own):
                    if n == 0 and i in rests:
                        continue
                    whole = n == len(own) - 1 and i in breaks
                    words.append(breaks[i][1] + breaks[i][2] if whole else w)
                    spots.append((i, -1, -1) if whole else (i, a, b))
        changes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
        for at, (w, spot) in enumerate(zip(words, spots, strict=True)):
            if w not in self.right and (w.isalpha() or w.isdigit()):
                if spot[1] >= 0 or not (breaks[spot[0]][1] in self.right or breaks[spot[0]][2] in self.right):
                    continue
            right = self.word(w, words, at)
            if spot[1] >= 0:
                if right:
                    wrong.add(spot[0])
                    changes[spot[0]].append((spot[1], spot[2], right))
                continue
            i = spot[0]
            j, a, b = breaks[i]
            end, begin = len(lines[i].rstrip()) - 1, len(lines[j]) - len(lines[j].lstrip())
            if right:
                p = 0
                while p < min(len(right), len(w)) and right[p] == w[p]:
                    p += 1
                if p < len(a):
                    wrong.add(i)
                    changes[i].append((end - len(a), end, right[: len(right) - len(b)]))
                else:
                    wrong.add(j)
                    changes[j].append((begin, begin + len(b), right[len(a) :]))
            else:  # not known as a whole: its longer parts may be words
                for part, k, start in ((a, i, end - len(a)), (b, j, begin)):
                    own = self.word(part, words, at) if len(part) > 3 else None
                    if own:
                        wrong.add(k)
                        changes[k].append((start, start + len(part), own))
        for at, i in enumerate(body):
            line = lines[i]
            for m in DECIMAL.findall(line) if numbers else ():
                if not m.replace(".", "").replace(",", "").isdigit():
                    wrong.add(i)
                    fixed[i] = fixed[i].replace(m, m.translate(DIGITS))
            if not plain:
                before = lines[body[at - 1]][-1:] if at else ""
                after = lines[body[at + 1]][:1] if at + 1 < len(body) else ""
                found = self.signs(line, before, after)
                if found:
                    wrong.add(i)
                    chars = list(fixed[i])  # decimals keep their length
                    for p, c in found:
                        chars[p] = c
                    fixed[i] = "".join(chars)
            for a, b, right in sorted(changes.get(i, ()), reverse=True):
                if lines[i][a:b] == fixed[i][a:b]:  # not within a decimal
                    fixed[i] = fixed[i][:a] + right + fixed[i][b:]
        events += [(i + 1, "char") for i in wrong]
        return events, self.reflow(fixed, frame, breaks) if repair else None

    def reflow(self, lines: list[str], frame: list[bool], breaks: dict) -> str:
        """The body as paragraphs: lines joined, broken words whole, furniture gone."""
        out, glue = "", ""
        for i, line in enumerate(lines):
            if frame[i]:
                continue
            t = line.strip()
            if not t:
                # a blank beside furniture is the frame's, not a paragraph's end
                near = (i > 0 and frame[i - 1]) or (i + 1 < len(lines) and frame[i + 1])
                glue = glue if near else "\n\n"
                continue
            if out and not glue:
                glue = " "
            if glue == " " and (re.match(r"[-*•#|>]\s|\|", t) or out.endswith("|") or out[-1] in ".:;!?。；：" and re.match(r"\d{1,3}[.)]\s", t)):
                glue = "\n"
            if glue == " " and (RUN.match(out[-1:]) or out[-1:] in "，。、；：！？") and not t[0].isascii():
                glue = ""
            out += glue + t
            glue = ""
            if i in breaks:
                out = out[:-1]
                glue = "\0"
        return out.replace("\0", "")


def header_keys(items: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source_id, key), (source_id, keys) of each package's running lines, and (key) of status lines.

    A status line is a running line of at least SHARING packages that no package has as its title: it is furniture in all.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, k, t) for s, line, t in zip(pdf["source_id"], pdf["line"], pdf["title"], strict=True) for k in {key(line), *line_keys(line)}]
            yield pd.DataFrame(rows, columns=["source_id", "key", "title"])

    lines = items.where(F.col("item_type").isin("page_header", "page_footer") & F.col("raw_text").isNotNull()).select("source_id", F.col("raw_text").alias("line"), F.lit(False).alias("title"))
    titles = packages.where("title is not null").select(F.col("package_id").alias("source_id"), F.col("title").alias("line"), F.lit(True).alias("title"))
    every = cut_lineage(lines.unionByName(titles).where("source_id is not null").distinct().mapInPandas(run, "source_id string, key bigint, title boolean").distinct())
    each = every.select("source_id", "key").distinct()
    shared = every.groupBy("key").agg(F.max("title").alias("title"), F.count_if(~F.col("title")).alias("n")).where(~F.col("title") & (F.col("n") >= SHARING)).select("key")
    return each, each.groupBy("source_id").agg(F.collect_set("key").alias("keys")), shared


def cache_keys(cache: DataFrame, assets: DataFrame, each: DataFrame) -> DataFrame:
    """(sha256, keys): the keys of an image's lines that its packages know as running lines.

    Semi-joined per line, so an image that lies in very many packages gathers no more than its own lines.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(s, k) for s, t in zip(pdf["sha256"], pdf["text"], strict=True) for line in t.split("\n") if len(line) > 2 for k in line_keys(line)]
            yield pd.DataFrame(rows, columns=["sha256", "key"])

    lines = cache.where("ocr.text like '%\n%'").select("sha256", F.col("ocr.text").alias("text")).mapInPandas(run, "sha256 string, key bigint").distinct()
    homes = assets.select(F.lower(F.trim("sha256")).alias("sha256"), "source_id").distinct()
    known = homes.join(each, "source_id").select("sha256", "key").distinct()
    return lines.join(known, ["sha256", "key"], "left_semi").groupBy("sha256").agg(F.collect_set("key").alias("keys"))


def text_keys(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(text_hash, status): the keys of status lines in each text, where there are too many of them to broadcast."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(h, k) for h, t in zip(pdf["text_hash"], pdf["text"], strict=True) for line in t.split("\n") if len(line) > 2 for k in line_keys(line)}
            yield pd.DataFrame(list(rows), columns=["text_hash", "key"])

    lines = texts.where("text like '%\n%'").select(F.xxhash64("text").alias("text_hash"), "text").mapInPandas(run, "text_hash bigint, key bigint").distinct()
    return lines.join(shared, "key", "left_semi").groupBy("text_hash").agg(F.collect_set("key").alias("status"))


def scanned_texts(items: DataFrame, cache: DataFrame, packages: DataFrame, assets: DataFrame) -> tuple[DataFrame, set[int]]:
    """All texts that may come from scans: rec_table, rec_key, ingested_at, text, keep, keys; and the keys of status lines."""
    each, keys, shared = header_keys(items, packages)
    own = items.where(~F.coalesce(F.col("item_type").isin(FRAME_TYPES), F.lit(False)) & F.col("raw_text").isNotNull() & (F.col("raw_text") != ""))
    own = own.select("source_id", F.col("item_id").alias("id"), "ingested_at", F.col("raw_text").alias("text"), F.coalesce(F.col("item_type").isin(KEEP_LINES), F.lit(False)).alias("keep"))
    own = spread(own)
    if keys.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("n")).first().n <= MOST_KEYS:
        own = own.join(F.broadcast(keys), "source_id", "left")
    else:
        own = salted_left_join(own, keys, ["source_id"], hot_keys(own, ["source_id"], items.count()), "id")
    none = F.array().cast("array<bigint>")
    a = own.select(F.lit("package_items").alias("rec_table"), F.concat_ws("#", "source_id", "id").alias("rec_key"), "ingested_at", "text", "keep", F.coalesce("keys", none).alias("keys"))
    read = cache.where("ocr.text is not null and ocr.text <> ''").select("sha256", "generated_at", F.col("ocr.text").alias("text"))
    b = read.join(cache_keys(cache, assets, each), "sha256", "left")
    b = b.select(F.lit("visual_cache").alias("rec_table"), F.col("sha256").alias("rec_key"), F.col("generated_at").alias("ingested_at"), "text", F.lit(False).alias("keep"), F.coalesce("keys", none).alias("keys"))
    texts = a.unionByName(b)
    shared = cut_lineage(shared)
    if shared.count() <= MOST_KEYS:
        return texts, {r.key for r in shared.collect()}
    marked = texts.withColumn("text_hash", F.xxhash64("text"))
    joined = salted_left_join(marked, text_keys(texts, shared), ["text_hash"], hot_keys(marked, ["text_hash"], texts.count()), "rec_key")
    return joined.withColumn("keys", F.concat("keys", F.coalesce("status", none))).select(*texts.columns), set()


def known_keys(everywhere: set[int], keys) -> set[int]:
    """The keys of the lines that are furniture in one text."""
    return everywhere.union(keys.tolist()) if len(keys) else everywhere


def with_own_links(texts: DataFrame, found: DataFrame, vocabulary: DataFrame, shared: set[int]) -> DataFrame:
    """texts with the links of their own words as an array ``own`` (null where there are none).

    The words that a text may look up are joined with the links by shuffle, once per distinct text; the commonest words
    without a link are left out before. Texts with very many copies are spread over the tasks of the last join.
    """
    plain = vocabulary.select("word", "n").join(found, "word", "left_anti").orderBy(F.desc("n"), "word").limit(MOST_WORDS)
    model = texts.sparkSession.sparkContext.broadcast(({r.word for r in plain.collect()}, shared))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, everywhere = model.value
        for pdf in batches:
            rows = set()
            for own, text, keep, keys in zip(pdf["text_hash"], pdf["text"], pdf["keep"], pdf["keys"], strict=True):
                lines, _, breaks = layout(text, known_keys(everywhere, keys), keep)
                words = {w for line in lines for w in WORD.findall(line)}
                for _, a, b in breaks.values():
                    words |= {a, b, a + b}
                rows.update((own, w) for w in words - common)
            yield pd.DataFrame(list(rows), columns=["text_hash", "word"])

    marked = texts.withColumn("text_hash", F.xxhash64("text"))
    pairs = marked.select("text_hash", "text", "keep", "keys").mapInPandas(run, "text_hash bigint, word string").distinct()
    lists = pairs.join(found, "word").groupBy("text_hash").agg(F.collect_list(F.struct(*found.columns)).alias("own"))  # the words of one text at most
    hot = hot_keys(marked, ["text_hash"], texts.count())
    return salted_left_join(marked, lists, ["text_hash"], hot, "rec_key").select(*texts.columns, "own")


def links_of(rows) -> dict[str, Link]:
    """word -> Link of rows of LINK_SCHEMA."""
    by: dict[str, list[tuple]] = defaultdict(list)
    for r in rows:
        by[r["word"]].append((r["right"], r["m"], r["odd"], r["cosine"], r["near"], r["own"], r["fit"]))
    return {w: Link(own) for w, own in by.items()}


def read_scans(items: DataFrame, cache: DataFrame, packages: DataFrame, assets: DataFrame, repair: bool = False) -> DataFrame:
    """Per record: rec_table, rec_key, events, and the repaired text if asked for.

    Every text is read once with all links of its words: up to MOST_LINKS they are broadcast, beyond that each text gets
    its own by a join.
    """
    texts, shared = scanned_texts(items, cache, packages, assets)
    spark = texts.sparkSession
    spoken = cut_lineage(spoken_texts(texts))
    vocabulary, space = learn(spoken)
    found = cut_lineage(links(vocabulary, space))
    # pairs with one of the few confusable signs: bounded by their number times the ideographs there are
    signs = spoken.select(F.explode(F.split("pairs", "\n")).alias("pair")).where(F.length("pair") == 2).where(F.col("pair").rlike(f"[{SIGN}]"))
    pairs = {r.pair: r["count"] for r in signs.groupBy("pair").count().collect()}
    schema = f"rec_table string, rec_key string, ingested_at timestamp, events {EVENT_TYPE}, repaired string"
    vast = found.count() > MOST_LINKS
    if vast:
        texts = with_own_links(texts, found, vocabulary, shared)
    model = spark.sparkContext.broadcast(([] if vast else [r.asDict() for r in found.collect()], pairs, shared, space))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, known, everywhere, space = model.value
        reader = Reader(links_of(rows), known, space)
        for pdf in batches:
            events, repaired = [], []
            for n, (text, keep, keys) in enumerate(zip(pdf["text"], pdf["keep"], pdf["keys"], strict=True)):
                if vast:
                    own = pdf["own"].iat[n]
                    reader.right = {} if own is None else links_of(own)
                e, t = reader.read(text, known_keys(everywhere, keys), keep, repair)
                events.append([{"line_no": at, "noise": k} for at, k in e])
                repaired.append(t)
            yield pdf[["rec_table", "rec_key", "ingested_at"]].assign(events=events, repaired=repaired)

    out = texts.mapInPandas(run, schema)
    if not repair:
        out = out.where(F.size("events") > 0)
    return earliest(out, ["rec_table", "rec_key"], ["events", "repaired"])
