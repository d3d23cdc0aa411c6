"""References to records that are missing, deleted or late (problem 2).

References and parent rows are partitioned by the same key (kind, source, id) and sorted by it; a merge join reads both
streams once. Each parent key carries its validity intervals [ingested_at, deleted_at), and a reference is an orphan
unless one of them holds the moment of the reference. The intervals tell the orphans apart:

* ``missing``: no row of that id in that source at any time,
* ``deleted``: rows had arrived by then, and all of them had been deleted,
* ``late``: rows exist, but none had arrived by then.

Nulls and blanks among references are none; a null source or record moment matches nothing and is reported; duplicates
of an element within a record count once; of re-delivered records the earliest row counts. Columns beside the named ones
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.skew import hot_keys, salted_left_join
from quillmark.sources.tables import earliest, table

KEY = ["kind", "source_id", "target_id"]
#: table, field, record id, moment, kind of parent
FIELDS = (
    ("chunks", "item_ids", "chunk_id", "ingested_at", "item"),
    ("chunks", "asset_ids", "chunk_id", "ingested_at", "asset"),
    ("package_items", "asset_ids", "item_id", "ingested_at", "asset"),
    ("eval_cases", "evidence_item_ids", "id", "created_at", "item"),
)


def strip(text: Column) -> Column:
    """text without blanks at its ends, ideographic and no-break ones included."""
    return F.regexp_replace(text, r"^[\s\u00A0\u3000]+|[\s\u00A0\u3000]+$", "")


def targets(field: str) -> Column:
    """The distinct references in an array column."""
    return F.array_distinct(F.filter(F.transform(F.col(field), strip), lambda x: x.isNotNull() & (x != "")))


def reference_rows(records: DataFrame, name: str, record: str, moment: str, fields: list[tuple[str, str]], dedupe: bool = True) -> DataFrame:
    """One row per reference: ref_table, ref_field, source_id, record_id, target_id, kind, ref_at."""
    names = [f for f, _ in fields]
    rows = earliest(records, ["source_id", record], names, moment) if dedupe else records.select("source_id", record, *names, moment)
    each = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(kind).alias("kind"), targets(f).alias("ids")) for f, kind in fields])
    rows = rows.select("source_id", F.col(record).alias("record_id"), F.col(moment).alias("ref_at"), F.inline(each))
    return rows.select(F.lit(name).alias("ref_table"), "ref_field", "source_id", "record_id", F.explode("ids").alias("target_id"), "kind", "ref_at")


def validity(parents: DataFrame, kind: str, id_column: str) -> DataFrame:
    """One row per parent key with its validity intervals; copies that share a deletion moment are combined first."""
    spans = parents.where(F.col("ingested_at").isNotNull()).groupBy("source_id", F.col(id_column).alias("target_id"), "deleted_at").agg(F.min("ingested_at").alias("ingested_at"))
    spans = spans.groupBy("source_id", "target_id").agg(F.collect_list(F.struct("ingested_at", "deleted_at")).alias("spans"))
    return spans.select(F.lit(kind).alias("kind"), "source_id", "target_id", "spans")


def orphan_references(references: DataFrame, parents: DataFrame, hot: DataFrame) -> DataFrame:
    """The references whose target was not there at their moment, with ``reason``."""
    joined = salted_left_join(references, parents, KEY, hot, "record_id")
    there = F.exists("spans", lambda s: (s.ingested_at <= F.col("ref_at")) & (s.deleted_at.isNull() | (s.deleted_at > F.col("ref_at"))))
    arrived = F.exists("spans", lambda s: s.ingested_at <= F.col("ref_at"))
    reason = F.when(F.col("spans").isNull(), "missing").when(F.coalesce(arrived, F.lit(False)), "deleted").otherwise("late")
    return joined.where(~F.coalesce(there, F.lit(False))).select("ref_table", "ref_field", "source_id", "record_id", "target_id", "ref_at", reason.alias("reason"))


def project_orphans(spark: SparkSession, folder: str) -> DataFrame:
    """orphan_references over the four reference fields of the project's tables."""
    frames, raw, total = [], [], 0
    for name in dict.fromkeys(f[0] for f in FIELDS):
        own = [f for f in FIELDS if f[0] == name]
        df, fields = table(spark, folder, name), [(f[1], f[4]) for f in own]
        frames.append(reference_rows(df, name, own[0][2], own[0][3], fields))
        raw.append(reference_rows(df, name, own[0][2], own[0][3], fields, dedupe=False))
        total += df.count()  # from the footers
    hot = hot_keys(raw[0].unionByName(raw[1]).unionByName(raw[2]), KEY, total)
    parents = validity(table(spark, folder, "package_items"), "item", "item_id").unionByName(validity(table(spark, folder, "assets"), "asset", "asset_id"))
    return orphan_references(frames[0].unionByName(frames[1]).unionByName(frames[2]), parents, hot)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field and month of the reference, by reason."""
    count = lambda r: F.count_if(F.col("reason") == r).alias(r)
    return orphans.groupBy("ref_table", "ref_field", F.date_format("ref_at", "yyyy-MM").alias("period")).agg(F.count("*").alias("orphans"), count("missing"), count("deleted"), count("late"))
