"""Column expressions that clean and check wiki pages and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions.text import empty

# fixed values: the mark before the managed block, and the kinds a page may have
MANAGED_START = r"(?s)<!-- [a-z]+:multimodal-evidence:start -->.*$"
KINDS = ["concept", "entity", "analysis", "source", "external_markdown"]


def clean_page(text: Column, title: Column) -> Column:
    """A page's own body: without front matter, managed evidence, an evidence section, and headings that repeat the title.

    Citations written as links become code. All front matter blocks at the start are removed, and blocks between lines of
    three dashes elsewhere.
    """
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = strip(empty(text))
    body = F.regexp_replace(body, r"(?s)^(?:---\n.*?\n---\s*)+", "")
    body = strip(F.regexp_replace(body, r"(?ms)^---\n.*?^---\n?", ""))
    body = F.regexp_replace(body, MANAGED_START, "")
    body = F.regexp_replace(body, r"(?s)\n## Evidence\n.*$", "")
    head = F.lower(F.concat(F.lit("# "), empty(title)))
    lines = F.split(body, "\n")
    flags = F.transform(lines, lambda x: (F.trim(x) == "") | (F.lower(F.trim(x)) == head))
    first = F.array_position(flags, False)
    kept = F.when(first > 0, strip(F.array_join(F.slice(lines, F.when(first > 0, first.cast("int")).otherwise(1), F.size(lines)), "\n"))).otherwise("")
    return F.regexp_replace(kept, r"\[\[([^\[\]\s]+@[^#\[\]]+#[^\[\]]+)\]\]", "`$1`")


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe, or null: empty, absolute, with a scheme, or leading outside."""
    p = empty(path)
    return F.when(F.trim(p) == "", "empty").when(p.rlike(r"^(/|[A-Za-z]:\\)"), "absolute").when(p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "scheme").when(p.rlike(r"(^|[/\\])\.\.([/\\]|$)"), "outside")


def repeats_title(text: Column, title: Column) -> Column:
    """Whether a page has its title as a first-level heading more than once."""
    heads = F.filter(F.split(F.lower(empty(text)), "\n"), lambda x: F.trim(x) == F.lower(F.concat(F.lit("# "), empty(title))))
    return F.size(heads) > 1
