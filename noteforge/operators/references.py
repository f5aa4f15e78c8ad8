"""References to records that do not exist, from signed counts per key.

Every change is a delta: a target row that arrives adds one to the existence of its key, a
deletion takes one away; a referring row adds one to the references, its withdrawal takes
one away. Running sums of the deltas in time order give both counts at every moment: a key
with positive references and no existence is an orphan. Sums over a delivery are merged into
the state of the earlier ones, so a delivery costs what it brings, not the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Changes of one key that one task handles; keys with more are split by day.
HOT = 1_000_000


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind; blank becomes null."""
    t = F.regexp_replace(c, r"^[\s\p{Z}\x{85}\x{FEFF}]+|[\s\p{Z}\x{85}\x{FEFF}]+$", "")
    return F.when(t != "", t)


def references(df: DataFrame, table_name: str, row_key: str, ref_key: Column, at: str, within: Column | None = None, until: str | None = None) -> DataFrame:
    """(table_name, row_key, ref_key, key, at, until) of every reference; null keys or times are none.

    until is when the referring row is withdrawn, null for never.
    """
    key = ref_key if within is None else F.concat(F.coalesce(within, F.lit("\u0000")), F.lit("\u0001"), ref_key)
    end = F.col(until) if until else F.lit(None).cast(df.schema[at].dataType)
    return df.select(F.lit(table_name).alias("table_name"), F.col(row_key).cast("bigint").alias("row_key"), ref_key.alias("ref_key"), key.alias("key"), F.col(at).alias("at"), end.alias("until")).where("key IS NOT NULL AND at IS NOT NULL")


def spans(df: DataFrame, table_name: str, key: Column, since: str, until: str | None = None, within: Column | None = None) -> DataFrame:
    """(table_name, key, since, until) in which a target row is present; empty spans are dropped.

    table_name is the referring table.
    """
    full = key if within is None else F.concat(F.coalesce(within, F.lit("\u0000")), F.lit("\u0001"), key)
    end = F.col(until) if until else F.lit(None).cast(df.schema[since].dataType)
    return df.select(F.lit(table_name).alias("table_name"), full.alias("key"), F.col(since).alias("since"), end.alias("until")).where("key IS NOT NULL AND since IS NOT NULL AND (until IS NULL OR until > since)")


def existence_deltas(present: DataFrame) -> DataFrame:
    """(table_name, key, at, exists): +1 on arrival, -1 on deletion, summed per key and moment."""
    changes = present.select("table_name", "key", F.explode(F.array(F.struct(F.col("since").alias("at"), F.lit(1).alias("d")), F.struct(F.col("until").alias("at"), F.lit(-1).alias("d")))).alias("c"))
    return changes.where("c.at IS NOT NULL").groupBy("table_name", "key", F.col("c.at").alias("at")).agg(F.sum("c.d").alias("exists"))


def changes(refs: DataFrame, present: DataFrame) -> DataFrame:
    """(table_name, key, at, kind, refs, exists, row_key, ref_key): all deltas; at one moment existence
    changes first, then references come, then they are withdrawn (never before they came)."""
    refs = refs.distinct()
    none = [F.lit(None).cast("bigint").alias("row_key"), F.lit(None).cast("string").alias("ref_key")]
    zero = F.lit(0).cast("bigint")
    existence = existence_deltas(present).select("table_name", "key", "at", F.lit(0).alias("kind"), zero.alias("refs"), "exists", *none)
    came = refs.select("table_name", "key", "at", F.lit(1).alias("kind"), F.lit(1).cast("bigint").alias("refs"), zero.alias("exists"), "row_key", "ref_key")
    if refs.schema["until"].dataType != refs.schema["at"].dataType:
        raise ValueError("until must be of the type of at")
    gone = refs.where("until IS NOT NULL").select("table_name", "key", F.greatest("at", "until").alias("at"), F.lit(2).alias("kind"), F.lit(-1).cast("bigint").alias("refs"), zero.alias("exists"), *none)
    return existence.unionByName(came).unionByName(gone)


def delivered(delivery: DataFrame, state: DataFrame | None = None, hot: int = HOT) -> DataFrame:
    """Orphans among the references of a delivery of changes: (table_name, row_key, ref_key, period).

    The signed counts of each key run from those of the state (all earlier deliveries, which
    must be of earlier moments) through the delivery; a reference is an orphan where its key then has
    positive references and no existence. Keys with more than `hot` changes are split by
    day, each day starting from the sums of the days before; the list of such keys has at
    most changes / hot rows.
    """
    rows = delivery
    if state is not None:
        empty = {"at": F.lit(None).cast(delivery.schema["at"].dataType), "kind": F.lit(-1), "row_key": F.lit(None).cast("bigint"), "ref_key": F.lit(None).cast("string")}
        rows = rows.unionByName(state.select("table_name", "key", "refs", "exists", *[c.alias(n) for n, c in empty.items()]))
    many = F.broadcast(rows.groupBy("table_name", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("table_name", "key", F.lit(True).alias("hot")))
    day = F.coalesce(F.unix_date(F.to_date("at")), F.lit(-(1 << 30)))
    rows = rows.join(many, ["table_name", "key"], "left").withColumn("day", F.when(F.col("hot"), day).otherwise(0))
    per = rows.where("hot").groupBy("table_name", "key", "day").agg(F.sum("refs").alias("r"), F.sum("exists").alias("e"))
    earlier = Window.partitionBy("table_name", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select("table_name", "key", F.sum("r").over(earlier).alias("refs"), F.sum("e").over(earlier).alias("exists"), "day").where("refs IS NOT NULL")
    rows = rows.drop("hot").unionByName(start.withColumn("kind", F.lit(-1)), allowMissingColumns=True)
    order = Window.partitionBy("table_name", "key", "day").orderBy(F.asc_nulls_first("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("asked", F.sum("refs").over(order)).withColumn("there", F.sum("exists").over(order))
    return counted.where("kind = 1 AND asked > 0 AND there <= 0").select("table_name", "row_key", "ref_key", F.date_format("at", "yyyy-MM").alias("period"))


def orphans(refs: DataFrame, present: DataFrame, hot: int = HOT) -> DataFrame:
    """References whose target is not there at their time: (table_name, row_key, ref_key, period).

    period is yyyy-MM of the reference. A target that arrives at the very time is there, one
    deleted at it is not. Rows are distinct; empty tables, repeated targets and targets that
    nothing refers to are fine. All changes are one delivery.
    """
    return delivered(changes(refs, present), None, hot)


def summed(delivery: DataFrame) -> DataFrame:
    """(table_name, key, refs, exists): what a delivery of changes adds to the state."""
    return delivery.groupBy("table_name", "key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))


def counts(refs: DataFrame, present: DataFrame) -> DataFrame:
    """State after all changes: (table_name, key, refs, exists)."""
    return summed(changes(refs, present)).where("refs <> 0 OR exists <> 0")


def merge_counts(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Add signed deltas (table_name, key, refs, exists) to a state; keys that come to nothing are dropped."""
    both = state.unionByName(deltas).groupBy("table_name", "key").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))
    return both.where("refs <> 0 OR exists <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with references and no target now."""
    return state.where("refs > 0 AND exists <= 0").select("table_name", "key", "refs")


def orphan_report(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, period, n_references, n_orphans, n_keys) per referring table and month."""
    asked = refs.distinct().groupBy("table_name", F.date_format("at", "yyyy-MM").alias("period")).agg(F.count("*").alias("n_references"))
    lost = found.groupBy("table_name", "period").agg(F.count("*").alias("n_orphans"), F.countDistinct("ref_key").alias("n_keys"))
    return asked.join(lost, ["table_name", "period"], "left").select("table_name", "period", "n_references", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"))
