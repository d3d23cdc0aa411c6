"""Checks of keys, references and coverage, each as rows that tell what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, with ``copies``. Null keys count as equal."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def conflicting_values(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The keys whose rows differ in a value, with ``lowest`` and ``highest``. Nulls are no values."""
    return rows.groupBy(*keys).agg(F.min(value).alias("lowest"), F.max(value).alias("highest")).where("lowest <> highest")


def missing_parents(child: DataFrame, parent: DataFrame, on: dict[str, str], name: str) -> DataFrame:
    """check, rows, distinct_keys: child rows whose key (not null) has no parent row.

    Child keys are counted first, so a hot key is one row in the join.
    """
    keys = list(on)
    counted = child.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(F.count("*").alias("n"))
    known = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    lost = counted.join(known, keys, "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys")).select(F.lit(name).alias("check"), "rows", "distinct_keys")


def set_difference(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with ``side`` (missing: expected only; extra: found only). Equal sets give no rows."""
    a, b = expected.select(*keys).distinct().withColumn("_e", F.lit(1)), found.select(*keys).distinct().withColumn("_f", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_f").alias("_f"))
    return both.where("_e is null or _f is null").select(*keys, F.when(F.col("_f").isNull(), "missing").otherwise("extra").alias("side"))


def coverage(sources: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """sources, covered, rate: how many of the sources any row covers; the rate of no sources is 1."""
    marked = sources.select(key).distinct().join(covered.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    total, hit = F.count("*"), F.count("hit")
    return marked.agg(total.alias("sources"), hit.alias("covered"), F.when(total == 0, F.lit(1.0)).otherwise(F.round(hit / total, 4)).alias("rate"))


def findings(*rules: tuple[str, str, DataFrame, Column]) -> DataFrame:
    """severity, rule, record: the union of checks (severity, rule, offending rows, name of the record)."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(s).alias("severity"), F.lit(r).alias("rule"), name.cast("string").alias("record")) for s, r, df, name in rules])


def case_problems(cases: DataFrame, packages: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """Problems of evaluation cases: repeated ids and questions, missing fields, unknown sources, items and pages."""
    repeated = lambda c: duplicate_keys(cases.where(F.col(c).isNotNull()), [c])
    evidence = cases.select("id", "source_id", F.explode("evidence_item_ids").alias("item_id")).where("item_id is not null").distinct()
    paths = cases.select("id", F.explode("wiki_page_paths").alias("path")).where("path is not null").distinct()
    return findings(
        ("error", "repeated_id", repeated("id"), F.col("id")),
        ("error", "repeated_question", repeated("question"), F.col("question")),
        ("error", "no_evidence", cases.where("coalesce(size(evidence_item_ids), 0) = 0"), F.col("id")),
        ("error", "no_answer", cases.where("expected_answerable and coalesce(expected_answer, '') = ''"), F.col("id")),
        ("error", "unknown_source", cases.join(packages.select(F.col("package_id").alias("source_id")), "source_id", "left_anti"), F.col("id")),
        ("error", "unknown_item", evidence.join(items.select("source_id", "item_id"), ["source_id", "item_id"], "left_anti").select("id").distinct(), F.col("id")),
        ("warning", "unknown_page", paths.join(pages.select("path"), "path", "left_anti").select("id").distinct(), F.col("id")),
    )
