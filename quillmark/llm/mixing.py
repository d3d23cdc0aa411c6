"""Mixing sources to target shares of tokens, by a low-discrepancy schedule of slots (problem 7).

Sizes are tokens of a public tokenizer. The documents of a source, in the order of a hash, are cut into blocks of equal
tokens (a document lies in the block where it starts). The slots of the mix are numbered; slot i takes the golden-ratio
point i * 0.618... mod 1, mapped through the cumulative weights to a source, so any stretch of the mix has the shares of
the whole. The k-th slot of a source takes its block k mod n in repeat k div n, and slots are joined with blocks.

The size of the mix is ``total`` tokens, or else the largest size at which every source that has any text meets its target
within max_repeats; weights of sources that cannot deliver go to the others in proportion, and with a given ``total`` a
source is held at its capacity (tokens x max_repeats) while the rest share what remains.

Defined results: null sources, sources without a target and texts without tokens are not drawn; names are compared without
case, blanks and hyphens; equal rows are rows of their own; a target whose source has no text reaches 0; null or
non-positive shares or repeats count as 0; with no text at all the mix is empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import cut_lineage
from quillmark.sources.tables import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the pattern of the vocabulary's words (GPT-2's, published)
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
SLOTS, BLOCK_TOKENS, BUCKET_ROWS, CHUNK = 20_000, 4096, 50_000, 65_536
MODULUS, STRIDE = 1 << 31, 1_327_217_885  # odd, nearest to MODULUS / golden ratio
MOST_SOURCES = 10_000


def source_key(name: Column) -> Column:
    """A source's name in one spelling."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s\-_]+", "_")


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents (doc_id, source_name, text) -> doc_id, source_name, tokens; whole texts, no shuffle."""
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encode = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            yield pdf.drop(columns="text").assign(tokens=[len(encode(t)) for t in pdf["text"]])

    return spread(documents.select("doc_id", "source_name", "text")).mapInPandas(run, "doc_id bigint, source_name string, tokens bigint")


def allocate(targets: dict[str, tuple[float, int]], available: dict[str, int], total: float | None = None) -> dict[str, float]:
    """source -> tokens of the mix."""
    room = {s: available.get(s, 0) * max(0, r) for s, (_, r) in targets.items()}
    weight = {s: w for s, (w, _) in targets.items() if w > 0 and room[s] > 0}
    if not weight:
        return {}
    whole = sum(weight.values())
    if total is None:
        total = min(room[s] * whole / w for s, w in weight.items())
    out: dict[str, float] = {}
    open_ = dict(weight)
    while open_:
        left = total - sum(out.values())
        whole = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / whole > room[s] * (1 + 1e-9)]
        if not full:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in full:
            out[s] = float(room[s])
            del open_[s]
    return out


def per_source(values: dict[str, float | int], kind: str) -> Column:
    """A value of the row's source."""
    return F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, v)])[F.col("source_name")].cast(kind)


def ranked(rows: DataFrame, group: list[str], size: Column, order: list[str], name: str) -> DataFrame:
    """rows with ``name``: the sum of ``size`` over all earlier rows of the source, in the order of (group, order).

    A sum of sums: each group is bounded, so no source passes through one task; only one row per group is ordered whole.
    """
    own = rows.withColumn("_size", size)
    sums = own.groupBy("source_name", *group).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("source_name").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source_name", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("source_name", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return own.join(base, ["source_name", *group]).withColumn(name, F.col("_base") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).drop("_base", "_size")


def mix_sources(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: slot, source_name, repeat, doc_id, tokens - one row per drawn record. report: source_name, target_share,
    max_repeats, available_tokens, tokens, reached_share, records, most_copies - one row per target.
    """
    goals = targets.where("source_name is not null").groupBy(source_key(F.col("source_name")).alias("source_name")).agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    wanted = {r.source_name: (r.target_share, r.max_repeats) for r in goals.limit(MOST_SOURCES + 1).collect()}
    if len(wanted) > MOST_SOURCES:
        raise ValueError("mix_targets must be a small table of sources")
    named = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_key(F.col("source")).alias("source_name"), "text")
    drawn = named.where(F.col("source_name").isin(list(wanted)) & F.col("text").isNotNull() & (F.col("text") != ""))
    sizes = cut_lineage(count_tokens(drawn, vocabulary).where("tokens > 0").withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tokens"), F.lit(MODULUS))))
    stats = {r.source_name: r for r in sizes.groupBy("source_name").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    plan = allocate(wanted, {s: r.tokens for s, r in stats.items()}, total)
    spark = documents.sparkSession
    if not plan:
        mix = spark.createDataFrame([], "slot bigint, source_name string, repeat int, doc_id bigint, tokens bigint")
        return mix, _report(goals, sizes, mix)
    size = sum(plan.values())
    block = max(1.0, min(BLOCK_TOKENS, size / SLOTS))
    slots = ceil(size / block)
    blocks = {s: max(1, round(stats[s].tokens / block)) for s in plan}
    # documents to blocks
    buckets = per_source({s: max(1, ceil(stats[s].n / BUCKET_ROWS)) for s in plan}, "bigint")
    placed = sizes.where(F.col("source_name").isin(list(plan))).withColumn("bucket", F.shiftright(F.col("h") * buckets, 31))
    placed = ranked(placed, ["bucket"], F.col("tokens"), ["h", "doc_id"], "start")
    share = F.col("start") / per_source({s: stats[s].tokens for s in plan}, "double")
    placed = placed.select("source_name", F.least(F.floor(share * per_source(blocks, "double")), per_source(blocks, "bigint") - 1).alias("block"), "doc_id", "tokens")
    # slots to sources and blocks
    point = F.pmod(F.pmod(F.col("slot"), F.lit(MODULUS)) * F.lit(STRIDE), F.lit(MODULUS)) / F.lit(float(MODULUS))
    edge, source = 0.0, F.lit(list(plan)[-1])
    steps = []
    for s in plan:
        edge += plan[s] / size
        steps.append((s, edge))
    for s, e in reversed(steps[:-1]):
        source = F.when(F.col("point") < e, s).otherwise(source)
    scheduled = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("source_name", source).withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    scheduled = ranked(scheduled, ["chunk"], F.lit(1), ["slot"], "k")
    count = per_source(blocks, "bigint")
    scheduled = scheduled.select("slot", "source_name", F.pmod("k", count).alias("block"), F.floor(F.col("k") / count).cast("int").alias("repeat"))
    scheduled = scheduled.where(F.col("repeat") < per_source({s: wanted[s][1] for s in plan}, "int"))
    mix = scheduled.join(placed, ["source_name", "block"]).select("slot", "source_name", "repeat", "doc_id", "tokens")
    return mix, _report(goals, sizes, mix)


def _report(goals: DataFrame, sizes: DataFrame, mix: DataFrame) -> DataFrame:
    copies = mix.groupBy("source_name", "doc_id", "tokens").agg(F.countDistinct("repeat").alias("copies"), F.count("*").alias("n"))
    reached = copies.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("records"), F.max("copies").alias("most_copies"))
    have = sizes.groupBy("source_name").agg(F.sum("tokens").alias("available_tokens"))
    rows = goals.join(have, "source_name", "left").join(reached, "source_name", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    rows = rows.select("source_name", "target_share", "max_repeats", zero("available_tokens"), zero("tokens"), zero("records"), zero("most_copies"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target, at most MOST_SOURCES
    return rows.withColumn("reached_share", F.coalesce(F.col("tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)))
