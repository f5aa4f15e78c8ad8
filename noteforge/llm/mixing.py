"""Sources combined to target shares of tokens, by a low-discrepancy schedule.

Slots of equal size are given to sources by golden-ratio points mapped through the cumulative
shares, so every stretch of the schedule is close to the targets. The notes of each source
are shuffled, laid end to end (repeated as whole passes, each shuffled anew) and cut into
blocks of one slot each; a note belongs to the block that holds its middle, so a source gives
its share to within half a note; the r-th slot of a source takes its r-th block.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.session import cut, ship

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How the public byte-level vocabularies part a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
GOLDEN = (math.sqrt(5) - 1) / 2
#: Notes of one source that one task orders, and slots that one task ranks.
BUCKET_NOTES = 20_000
CHUNK_SLOTS = 100_000


def token_counts(df: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """df with n_tokens of text_col by a public byte-level vocabulary; null counts 0.

    The vocabulary file is read by the driver and sent to the tasks (about a megabyte).
    """
    ship(df.sparkSession)
    with open(tokenizer, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0)

    return df.withColumn("n_tokens", count(F.col(text_col)))


@dataclass
class Plan:
    """One row per listed source: what it is to give and what it has."""

    sources: list[str]
    shares: list[float]  # as listed
    weights: list[float]  # over sources that have notes; sums to 1
    repeats: list[int]
    tokens: list[int]
    notes: list[int]
    total: int  # tokens to aim at
    block: int  # tokens of one slot

    @property
    def slots(self) -> int:
        return self.total // self.block if self.block else 0


def plan_mix(supply: list[tuple[str, float, int, int, int]], total: int | None = None, block: int | None = None) -> Plan:
    """supply: (source, target share, max repeats, tokens, notes) per listed source.

    Sources without notes, share or allowed use get weight 0 and the others share the whole in
    proportion. Without `total` it is the largest at which no source has to exceed its cap.
    """
    supply = sorted(supply)
    usable = [max(0.0, w or 0.0) if t > 0 and (r or 0) > 0 else 0.0 for _, w, r, t, _ in supply]
    whole = sum(usable)
    weights = [u / whole if whole > 0 else 0.0 for u in usable]
    reach = [r * t / w for (_, _, r, t, _), w in zip(supply, weights) if w > 0]
    most = int(min(reach)) if reach else 0
    total = most if total is None else total
    block = block or max(64, min(8192, total // 5000))
    return Plan([s[0] for s in supply], [float(s[1] or 0.0) for s in supply], weights, [int(s[2] or 0) for s in supply], [int(s[3]) for s in supply], [int(s[4]) for s in supply], total, block)


def _per_source(plan: Plan, values: list, source: Column) -> Column:
    kind = F.create_map(*[x for s, v in zip(plan.sources, values) for x in (F.lit(s), F.lit(v))])
    return F.element_at(kind, source)


def schedule(spark, plan: Plan) -> DataFrame:
    """(slot, source, turn): which source each slot is for, and the how-manieth of that source it is."""
    if not plan.slots:
        return spark.createDataFrame([], "slot bigint, source string, turn bigint")
    edges, names, cum = [], [], 0.0
    for s, w in zip(plan.sources, plan.weights):
        if w > 0:
            cum += w
            edges.append(cum)
            names.append(s)
    point = F.col("slot").cast("double") * F.lit(GOLDEN) + F.lit(0.5)
    slots = spark.range(plan.slots).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    number = F.least(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("u"))) + 1, F.lit(len(names)))
    slots = slots.select("slot", F.element_at(F.array(*[F.lit(n) for n in names]), number).alias("source"), F.floor(F.col("slot") / CHUNK_SLOTS).alias("chunk"))
    per = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = per.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = slots.withColumn("r", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
    return inside.join(before, ["source", "chunk"]).select("slot", "source", (F.col("before") + F.col("r") - 1).alias("turn"))


def blocks(sized: DataFrame, plan: Plan, seed: int = 1) -> DataFrame:
    """(source, turn, doc_id, n_tokens, pass, at): every use of a note within the passes that can be needed.

    The running sum over a source is made in two steps (buckets of the shuffle, then within
    each), so no task holds a whole source.
    """
    need = [min(r, math.ceil((w * plan.slots + 2 + math.log2(plan.slots + 2)) * plan.block / t)) if w > 0 else 0 for w, r, t in zip(plan.weights, plan.repeats, plan.tokens)]
    used = sized.where(F.col("source").isin([s for s, n in zip(plan.sources, need) if n > 0]) & (F.col("n_tokens") > 0))
    if not plan.sources or not any(need):
        used = sized.where("false")
        return used.select("source", F.lit(0).cast("bigint").alias("turn"), "doc_id", "n_tokens", F.lit(0).alias("pass"), F.lit(0).cast("bigint").alias("at"))
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(0), _per_source(plan, [max(0, n - 1) for n in need], F.col("source")))))
    order = F.pmod(F.xxhash64(F.lit(seed), "pass", "doc_id"), F.lit(1 << 31))
    buckets = [max(1, n // BUCKET_NOTES) for n in plan.notes]
    used = used.withColumn("h", order).withColumn("bucket", F.floor(F.col("h") * _per_source(plan, buckets, F.col("source")) / F.lit(float(1 << 31))).cast("int"))
    per = used.groupBy("source", "pass", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = per.select("source", "pass", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("pass", "bucket")) - F.col("t")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "pass", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return (
        used.withColumn("inside", inside)
        .join(before, ["source", "pass", "bucket"])
        .select("source", F.floor((F.col("before") + F.col("inside") + F.col("n_tokens") / 2) / plan.block).cast("bigint").alias("turn"), "doc_id", "n_tokens", "pass", (F.col("before") + F.col("inside")).cast("bigint").alias("at"))
    )


class Mixture:
    """A mixture of (doc_id, source, text) to targets (source, target_share, max_repeats).

    Notes with null source, of unlisted sources, or without tokens are never used. Repeated
    target rows of one source count once (the largest). Empty tables give empty results.
    """

    def __init__(self, notes: DataFrame, targets: DataFrame, total: int | None = None, block: int | None = None, seed: int = 1, tokenizer: str = TOKENIZER, pattern: str = PATTERN):
        self.spark, self.seed = notes.sparkSession, seed
        self.sized = cut(token_counts(notes.select("doc_id", "source", "text"), "text", tokenizer, pattern).select("doc_id", "source", "n_tokens"), "sized")
        have = self.sized.where("n_tokens > 0 AND source IS NOT NULL").groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("notes"))
        listed = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
        rows = listed.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("tokens", F.lit(0)), F.coalesce("notes", F.lit(0))).collect()  # one per listed source
        self.plan = plan_mix([tuple(r) for r in rows], total, block)

    def uses(self) -> DataFrame:
        """(slot, source, doc_id, n_tokens, pass, at): every use, in schedule order by (slot, at)."""
        return schedule(self.spark, self.plan).join(blocks(self.sized, self.plan, self.seed), ["source", "turn"]).select("slot", "source", "doc_id", "n_tokens", "pass", "at")

    def chosen(self) -> DataFrame:
        """(doc_id, source, n_tokens, repeats) of every note used."""
        return self.uses().groupBy("doc_id", "source", "n_tokens").agg(F.count("*").cast("int").alias("repeats"))

    def shares(self) -> DataFrame:
        """(source, target_share, actual_share, aim_share, tokens, short_tokens, notes, most_repeats, supply_tokens), listed sources all.

        aim_share is the target over the sources that have notes; short_tokens is what a source
        lacks of it, because its supply and repeats end or its notes are long for its share.
        """
        got = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("notes"), F.max("repeats").alias("most_repeats"))
        listed = self.spark.createDataFrame(list(zip(self.plan.sources, self.plan.shares, self.plan.weights, self.plan.tokens)), "source string, target_share double, aim_share double, supply_tokens bigint")
        joined = listed.join(got, "source", "left").fillna(0, ["tokens", "notes", "most_repeats"])
        whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per listed source
        short = F.greatest(F.lit(0), F.round(F.col("aim_share") * whole).cast("bigint") - F.col("tokens"))
        return joined.select("source", "target_share", (F.col("tokens") / F.greatest(whole, F.lit(1))).alias("actual_share"), "aim_share", "tokens", short.alias("short_tokens"), "notes", "most_repeats", "supply_tokens")
