"""Keyword-stuffed, link-list and tag-pile pages, by robust Mahalanobis distance (problem 8).

Each document is cut into links, tags, table rows and segments (lines, sentences), and each segment is a sentence or not by
its share of function words. Features of the document: density (share of the characters in links, tags and recurring text
outside sentences), looseness (share outside sentences), repetition outside sentences, sameness (lack of entropy of the
words) and lack of function words; all but the density are shrunk towards an ordinary page by how much text there is, so
that short pages need no rule of their own. Per language and over all, medians and median absolute deviations scale the
features, a correlation matrix of clipped scores gives the shape; small languages borrow from all in proportion. Each
distinct text counts once in these statistics, however many copies there are. A document is spam if its distance from its
language or from all exceeds FAR and its offset, whitened by the same shape, lies within an angle of the spam direction.

Defined results: null and empty texts and null ids are never spam; documents without function words are measured by all;
equal texts are judged alike; documents with one id and several texts are spam if one is.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut_lineage
from quillmark.sources.tables import spread

FEATURES = ("density", "loose", "repeats", "sameness", "no_function")
#: least sizes of the scales, so that a feature that is 0 nearly everywhere keeps a usable one
FLOORS = (0.1, 0.2, 0.2, 0.1, 0.1)
#: the direction of spam: above all the density
DIRECTION = np.array([1.0, 0.3, 0.3, 0.1, 0.2])
#: 0.9999 quantile of chi-square with five degrees of freedom; least cosine with the direction of spam
FAR, LEAST_COSINE = 25.74, 0.5
LOGS = [0.0, *map(log, range(1, 4096))]
#: characters, grams, words of an ordinary page that features are shrunk by; texts of all that a language borrows
CLIP, PRIOR_CHARS, PRIOR_GRAMS, FEW_GRAMS, PRIOR_WORDS, ORDINARY, BORROWED = 3.0, 100, 30, 8, 20, 0.35, 50.0
FEATURE_SCHEMA = "doc_id bigint, text_hash bigint, language string, " + ", ".join(f"{f} double" for f in FEATURES)

# fixed values: common function words
FUNCTION_WORDS = {
    "en": "the of and to in is that for a an with was were by on as when which are be it its this these those from at or not has have had their they them there what how why who one some any each both before after while although because since so if than then about into only more most may must should can could will would once even though during between under over again no nothing",
    "de": "der die das den dem des und in von zu mit ist sind war wird werden wurde wurden dass nicht ein eine einer eines einem einen im am auf für als auch sich bei nach vor durch über unter weil damit haben hat ihre ihr sein seine es sie er wie nur oder aber aus an wenn noch bis zwischen sofern ohne wegen gemäß dabei dazu jede jeder",
    "fr": "le la les l de des du d et à au aux en un une est sont a ont été que qui qu ne pas pour par sur dans avec sans ce cette ces se s son sa ses leur leurs il elle nous on y ou mais plus afin être doit entre depuis lorsque comme si tout tous",
    "es": "el la los las de del y en un una uno es son se que no a al por para con sin su sus lo le les ha han fue fueron más entre desde como si cuando hasta sobre durante este esta estos estas pero o muy ya debe",
    "pt": "o a os as de do da dos das e em no na nos nas um uma é são se que não ao aos à às por para com sem seu sua seus suas foi foram mais entre desde como quando até sobre este esta isso mas ou muito já deve depois pelo pela ter teria sido",
}
FUNCTION_SIGN = re.compile("[的了在是和与被将并因此对从把为应所以及其由于不会这已后再先若仅但则该各每也而或都就]")
WORDS = {w: frozenset(x for x, v in FUNCTION_WORDS.items() if w in v.split()) for v in FUNCTION_WORDS.values() for w in v.split()}

PLAIN_LINK = r"<a\s[^>]*>.*?</a>|!?\[[^\]\n]*\]\([^)\s]*\)|\[\[[^\]\n]*\]\]|(?:https?://|www\.)[^\s<>]+"
LINK = re.compile(PLAIN_LINK, re.S)
#: also a title, an arrow and an address; dearer, so only for texts with arrows
ARROW_LINK = re.compile(r"(?:^|(?<=[\n»·•|*<>.!?。！？]))[^\n»·•|*<>.!?。！？]*+» (?:https?://|www\.)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?|" + PLAIN_LINK, re.S)
TAG = re.compile(r"(?<![\w/])[#@+][^\W_][\w-]*|(?:^|(?<=[;,/|\n；，、•·] )|(?<=[\n;,/|；，、•·])|(?<=^))[^\W\d_][^\W\d_]{0,18}[:：=]\S[^\n;；,，/|•·。.!?]{0,60}(?=$|[\n;；,，/|•·])", re.M)
SEGMENT = re.compile(r"[^\n.!?。！？]+(?:[.!?](?=\S)[^\n.!?。！？]*)*[.!?。！？]*")
LATIN = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
SIGNS = re.compile("[぀-ヿ㐀-鿿]")
LOOSE_WORD = re.compile(r"[^\W\d_]+")
KANA = re.compile("[぀-ゟ]")
TABLE = re.compile(r"\s*\|.*\|\s*$")
WIDE = re.compile("[！-～]{2}[Ａ-Ｚａ-ｚ]")
NGRAM = 5


def language_of(counts: dict[str, int], signs: int, kana: int) -> str:
    """The language whose function words are the most, or that of the script."""
    if signs > 2 * len(counts) or signs > sum(counts.values()) / 2:
        return "ja" if kana * 10 > signs else "zh"
    votes: dict[str, int] = {}
    for w in WORDS.keys() & counts.keys():
        for lang in WORDS[w]:
            votes[lang] = votes.get(lang, 0) + counts[w]
    return max(sorted(votes), key=votes.__getitem__) if votes else "none"


def is_sentence(segment: str) -> tuple[bool, int, int, list[str]]:
    """Whether a segment reads as a sentence; its tokens, function words among them and words."""
    signs = SIGNS.findall(segment) if not segment.isascii() else []
    if len(signs) * 4 > len(segment):
        kana = len(KANA.findall(segment))
        if kana * 10 > len(signs):
            return len(signs) >= 8 and kana * 4 > len(signs), len(signs), kana // 3, signs
        functional = kana or len(FUNCTION_SIGN.findall(segment))
        varied = len(signs) < 8 or len(set(zip(signs, signs[1:], strict=False))) * 3 >= (len(signs) - 1) * 2
        return len(signs) >= 8 and varied and functional * 22 >= len(signs), len(signs), functional, signs
    words = LATIN.findall(segment.lower())
    functional = len([w for w in words if w in WORDS])
    varied = len(words) < 12 or len(set(words)) * 2 >= len(words)
    ended = segment[-1] in ".!?:" or len(words) >= 7
    # words run together count as what their letters would make
    spoken = max(len(words), len(segment) // 12)
    return ended and len(words) >= 4 and varied and functional * 6 >= spoken, spoken, functional, words


def recurring(odd: list[str]) -> tuple[float, float]:
    """(share of the grams of some segments that occur more than once, share of those that repeat an earlier one), shrunk."""
    flat = re.sub(r"[\W\d_]+", "", " ".join(odd).lower())
    step = 3 if SIGNS.match(flat) else NGRAM
    grams = Counter([flat[i : i + step] for i in range(len(flat) - step + 1)])
    n = sum(grams.values())
    return (n - sum(c == 1 for c in grams.values())) / (n + FEW_GRAMS), (n - len(grams)) / (n + PRIOR_GRAMS)


def features(text: str) -> tuple[str, list[float]]:
    """(language, the features) of one document."""
    if WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    links = tags = 0
    rest = text
    odd: list[str] = []
    if "://" in text or "[[" in text or "](" in text or "<a" in text or "»" in text or "www." in text:
        parts, last = [], 0
        for m in (ARROW_LINK if "»" in text else LINK).finditer(text):
            links += len(m[0].strip())
            odd.append(m[0])
            parts.append(text[last : m.start()])
            last = m.end()
        rest = "\n".join([*parts, text[last:]])
    if ":" in rest or "：" in rest or "=" in rest or "#" in rest or "@" in rest or "+" in rest:
        found = TAG.findall(rest)
        if found:
            tags = sum(map(len, found))
            odd += found
            rest = TAG.sub("\n", rest)
    sentence = tokens = functional = tabular = 0
    words: list[str] = []
    bare: list[str] = []
    for line in rest.split("\n"):
        if "|" in line and TABLE.match(line):
            tabular += len(line.strip())
            continue
        for segment in SEGMENT.findall(line):
            own = segment.strip(" \t\r-*•·>|,;，；、/")
            if not own:
                continue
            good, n, f, w = is_sentence(own)
            tokens += n
            functional += f
            words += w
            if good:
                sentence += len(own)
            else:
                bare.append(own)
    loose = sum(map(len, bare))
    total = max(1, links + tags + sentence + loose + tabular)
    stuffed = loose * recurring(bare)[0] if bare else 0.0
    repeats = recurring(odd + bare)[1] if odd or bare else 0.0
    signs = len(SIGNS.findall(rest)) if not rest.isascii() else 0
    kana = len(KANA.findall(rest)) if signs else 0
    counts = Counter(words)
    n = len(words)
    entropy = log(n) - sum(c * LOGS[c] if c < 4096 else c * log(c) for c in counts.values()) / n if n > 1 else 0.0
    sameness = (1 - entropy / log(n)) * n / (n + PRIOR_WORDS) if n > 1 else 0.0
    no_function = 1 - (functional + ORDINARY * PRIOR_WORDS) / (tokens + PRIOR_WORDS)
    return language_of(counts, signs, kana), [(links + tags + stuffed) / total, (links + tags + loose) / (total + PRIOR_CHARS), repeats, sameness, no_function]


def page_features(documents: DataFrame) -> DataFrame:
    """FEATURE_SCHEMA, one row per document with text; a map without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, known, text in zip(batch["doc_id"].tolist(), batch["text_hash"].tolist(), batch["text"].tolist(), strict=True):
                language, values = features(text)
                rows.append((doc, known, language, *values))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "language", *FEATURES])

    return spread(documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")).mapInPandas(run, FEATURE_SCHEMA)


def shaped(features_table: DataFrame) -> DataFrame:
    """The features with ``distance`` (squared robust Mahalanobis distance), ``toward`` (cosine with the direction of spam,
    both whitened) and ``spam``.

    They are those of the document's language or of all documents, whichever makes it spam or has it farther out. Medians,
    deviations and correlations are aggregates over all distinct texts, copies combined before the shuffle; what reaches
    the driver is one row per language. The features table is read several times: cut its lineage before.
    """
    spark = features_table.sparkSession
    columns = [c for c in features_table.columns if c != "text_hash"]
    # equal texts have equal features, so a distinct row is a distinct text
    texts = cut_lineage(features_table.select("text_hash", "language", *FEATURES).distinct())
    groups = F.when(F.col("language") == "none", F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), "language"))
    both = texts.withColumn("group", F.explode(groups))
    found = {r.group: r for r in both.groupBy("group").agg(F.count("*").alias("n"), *[F.percentile_approx(f, 0.5, 10_000).alias(f) for f in FEATURES]).collect()}
    if not found:
        return features_table.select(*columns, F.lit(0.0).alias("distance"), F.lit(0.0).alias("toward"), F.lit(False).alias("spam"))
    own_share = {g: 1.0 if g == "all" else r.n / (r.n + BORROWED) for g, r in found.items()}

    def blended(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The values of each language, those of all mixed in as if they were BORROWED texts more."""
        return {g: own_share[g] * v + (1 - own_share[g]) * values["all"] for g, v in values.items()}

    def lookup(values: dict[str, np.ndarray], i: int):
        return F.create_map(*[F.lit(x) for g, v in values.items() for x in (g, float(v[i]))])[F.col("group")]

    centre = blended({g: np.array([r[f] for f in FEATURES], float) for g, r in found.items()})
    offset = [F.col(f) - lookup(centre, i) for i, f in enumerate(FEATURES)]
    deviations = both.groupBy("group").agg(*[F.percentile_approx(F.abs(x), 0.5, 10_000).alias(f) for x, f in zip(offset, FEATURES, strict=True)]).collect()
    scale = blended({r.group: np.maximum([1.4826 * r[f] for f in FEATURES], FLOORS) for r in deviations})
    clipped = both.select("group", *[F.greatest(F.least(x / lookup(scale, i), F.lit(CLIP)), F.lit(-CLIP)).alias(f) for i, (x, f) in enumerate(zip(offset, FEATURES, strict=True))])
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    moments = clipped.groupBy("group").agg(*[F.avg(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"m{i}_{j}") for i, j in pairs]).collect()
    parameters = []
    for group, m in blended({r.group: np.array([r[f"m{i}_{j}"] for i, j in pairs]) for r in moments}).items():
        shape = np.zeros((len(FEATURES),) * 2)
        for (i, j), x in zip(pairs, m, strict=True):
            shape[i, j] = shape[j, i] = x
        # a variance of at least 1 keeps constant features from blowing distances up
        shape = shape / np.sqrt(np.outer(d := np.maximum(np.diag(shape), 1.0), d)) + 0.1 * np.eye(len(FEATURES))
        np.fill_diagonal(shape, np.maximum(np.diag(shape), 1.0))
        inverse = np.linalg.inv(shape)
        course = inverse @ DIRECTION
        parameters.append((group, centre[group].tolist(), scale[group].tolist(), inverse.tolist(), (course / np.sqrt(DIRECTION @ course)).tolist()))
    small = spark.createDataFrame(parameters, "group string, centre array<double>, scale array<double>, inverse array<array<double>>, course array<double>")
    group = F.when(F.col("language").isin([g for g in found if g != "all"]), F.col("language")).otherwise("all")
    measures = F.struct("centre", "scale", "inverse", "course")
    own, every = small.select("group", measures.alias("own")), small.where("group = 'all'").select(measures.alias("every"))
    scored = features_table.withColumn("group", group).join(F.broadcast(own), "group").crossJoin(F.broadcast(every))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def z(m: str):
        return F.zip_with(F.zip_with(F.array(*FEATURES), f"{m}.centre", lambda x, c: x - c), f"{m}.scale", lambda x, c: x / c)

    def measured(m: str):
        distance = dot(F.transform(f"{m}.inverse", lambda row: dot(row, F.col(f"z_{m}"))), F.col(f"z_{m}"))
        toward = dot(F.col(f"{m}.course"), F.col(f"z_{m}")) / F.sqrt(F.greatest(distance, F.lit(1e-9)))
        return F.struct(((distance > FAR) & (toward > LEAST_COSINE)).alias("spam"), distance.alias("distance"), toward.alias("toward"))

    farther = F.greatest(measured("own"), measured("every"))
    scored = scored.withColumn("z_own", z("own")).withColumn("z_every", z("every")).select(*columns, farther.alias("farther"))
    return scored.select(*columns, "farther.distance", "farther.toward", "farther.spam")


def spam_pages(features_table: DataFrame) -> DataFrame:
    """The spam pages: outliers of their language or of all that lie in the direction of spam."""
    return shaped(features_table).where("spam")
