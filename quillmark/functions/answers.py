"""Normalising answers, formulas and model output: the pieces that built-in expressions cannot say."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PUNCTUATION = re.compile(r"[\s，。；：、,.!?！？;:'\"“”‘’（）()\[\]【】]+")
#: code, formulas of three kinds in delimiters, and what may be one in single dollars
SPAN = re.compile(r"(?P<code>```.*?```|`[^`\n]*`)|\\\[(?P<bracket>.*?)\\\]|(?<!\\)\$\$(?P<block>.+?)\$\$|\\\((?P<line>.*?)\\\)|(?<![\\$])\$(?P<dollar>[^$\n]+)(?<!\\)\$(?!\$)", re.S)
MARKS = re.compile(r'\\.|["{}]', re.S)
MATHLIKE = re.compile(r"[\\_^{}=<>±×÷∑∏√∞≈≠≤≥]|^[A-Za-z]\d*$|[A-Za-z0-9)]\s*[+*/-]\s*[(A-Za-z0-9]|^[A-Za-z]+\s*\([^()]+\)$")


def plain_answer(text: str | None) -> str:
    """An answer without case, width, blanks and punctuation."""
    return PUNCTUATION.sub("", unicodedata.normalize("NFKC", text or "").lower())


@F.pandas_udf(StringType())
def normalized_answer(texts: pd.Series) -> pd.Series:
    return texts.map(plain_answer)


def math_delimiters(text: str | None) -> str | None:
    """Formulas as \\( \\) in lines and $$ in blocks; code stays, and so do dollars that enclose no formula.

    One scan from the left: each span is written in its form, and of a pair of dollars without a formula only the first is
    passed over, as the second may open one.
    """
    if text is None:
        return None
    out, at = [], 0
    while found := SPAN.search(text, at):
        kind, inner = found.lastgroup, found[found.lastgroup].strip()
        end = found.end()
        if kind == "code":
            form = found[0]
        elif kind in ("bracket", "block"):
            form = f"\n$$\n{inner}\n$$\n"
        elif kind == "line" or MATHLIKE.search(inner):
            form = f"\\({inner}\\)"
        else:
            form, end = "$", found.start() + 1
        out += [text[at : found.start()], form]
        at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def normalized_math(texts: pd.Series) -> pd.Series:
    return texts.map(math_delimiters)


def objects_in(text: str) -> Iterator[str]:
    """The stretches of text from an opening brace to the one that closes it, braces in strings aside; none within another."""
    depth = start = 0
    quoted = False
    for mark in MARKS.finditer(text):
        sign = mark[0]
        if depth and sign == '"':
            quoted = not quoted
        elif not quoted and sign == "{":
            start = start if depth else mark.start()
            depth += 1
        elif not quoted and depth and sign == "}":
            depth -= 1
            if not depth:
                yield text[start : mark.end()]


def lenient_json(text: str | None) -> str | None:
    """The first JSON object in a model's output (fenced, amid prose, or encoded as a string) as JSON text; null without one."""
    body = (text or "").strip()
    if body.startswith('"') and body.endswith('"'):
        try:
            body = json.loads(body)
        except ValueError:
            pass
    for part in objects_in(body):
        try:
            return json.dumps(json.loads(part), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    return texts.map(lenient_json)
