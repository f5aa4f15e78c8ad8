"""Caption corpora: parsing, reject reasons, ids, keep-first and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteforge.functions.text import normalized, restored_segments, without_tags
from noteforge.operators.ordering import dense_ids, running
from noteforge.session import cut, salted_join


def caption_pairs(df: DataFrame, id_col: str, text_col: str, images_col: str) -> DataFrame:
    """One row per image id of every usable caption (filled text, at least one image): (id, text, image_id)."""
    good = df.where((F.trim(text_col) != "") & (F.size(images_col) > 0))
    return good.select(F.col(id_col), F.col(text_col), F.explode(images_col).alias("image_id")).where("image_id IS NOT NULL")


def decoded_images(lines: DataFrame, needed: DataFrame, order: str = "ordinal", line: str = "line") -> DataFrame:
    """(image_id, payload, status) from lines `image_id TAB base64`.

    Lines without a tab or with bad Base64 are `malformed`; ids that nobody needs are skipped;
    of repeated ids the first stays, the others are `duplicate`.
    """
    from noteforge.functions.text import from_base64

    parts = F.split(line, "\t", 2)
    t = lines.select(order, F.when(F.size(parts) == 2, F.element_at(parts, 1)).alias("image_id"), F.when(F.size(parts) == 2, from_base64(F.element_at(parts, 2))).alias("payload"))
    bad = t.where("image_id IS NULL OR payload IS NULL").select(order, "image_id", F.lit(None).cast("binary").alias("payload"), F.lit("malformed").alias("status"))
    good = t.where("image_id IS NOT NULL AND payload IS NOT NULL").join(needed.select("image_id").distinct(), "image_id", "left_semi")
    first = good.groupBy("image_id").agg(F.min(order).alias("_first"))
    good = good.join(first, "image_id").select(order, "image_id", F.when(F.col(order) == F.col("_first"), F.col("payload")).alias("payload"), F.when(F.col(order) == F.col("_first"), "kept").otherwise("duplicate").alias("status"))
    return good.unionByName(bad)


def _first_wins(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with name = true for the first row of each key, null without a key; hot keys are split."""
    first = df.dropna(subset=keys).groupBy(*keys).agg(F.min(order).alias("_first"))
    return salted_join(df, first, keys, order, how="left").withColumn(name, F.col(order) == F.col("_first")).drop("_first")


def parsed_segment_captions(lines: DataFrame, split_ids: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """Lines (ordinal, split, line) `image#lang#n text` with split_ids (split, image_id as string).

    (ordinal, split, source_text_id, text_id, image_id, text, reason): reason is null for kept
    lines, else the first of: malformed_caption, caption_without_split_mapping,
    malformed_caption_id, duplicate_caption_id, empty_clean_text. text_id counts all lines
    from 0, train before valid before test, rejected ones too.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")) - 1
    head, rest = F.regexp_extract("line", r"(?s)^([^ ]*) (.*)$", 1), F.regexp_extract("line", r"(?s)^([^ ]*) (.*)$", 2)
    parts = F.split(head, "#", -1)
    t = lines.select("ordinal", "split", rank.alias("rank"), head.alias("source_text_id"), rest.alias("raw"), parts.alias("p"), (F.col("line").contains(" ") & (F.size(parts) == 3)).alias("formed"))
    t = t.withColumn("image", F.when(F.col("formed"), F.col("p")[0])).withColumn("lang", F.when(F.col("formed"), F.col("p")[1])).withColumn("n", F.when(F.col("formed"), F.col("p")[2]))
    t = dense_ids(t.withColumn("_o", F.col("rank") * (1 << 40) + F.col("ordinal")), "_o", "text_id").drop("_o")
    t = salted_join(t, split_ids.select("split", F.col("image_id").alias("image"), F.lit(True).alias("mapped")).distinct(), ["split", "image"], "ordinal", how="left")
    expected = F.when(F.col("split") == "test", "zhm").otherwise("zhb")
    reason = (
        F.when(~F.col("formed"), "malformed_caption").when(F.col("mapped").isNull(), "caption_without_split_mapping").when((F.col("lang") != expected) | ~F.col("n").rlike("^[0-9]+$"), "malformed_caption_id")
    )
    t = t.withColumn("reason", reason)
    t = _first_wins(t.withColumn("_k", F.when(F.col("reason").isNull(), F.col("source_text_id"))), ["split", "_k"], "ordinal", "_one")
    t = t.withColumn("reason", F.coalesce(F.col("reason"), F.when(~F.col("_one"), "duplicate_caption_id")))
    clean = F.when(F.col("split") == "test", without_tags(F.col("raw"))).otherwise(restored_segments(F.col("raw")))
    t = t.withColumn("text", clean).withColumn("reason", F.coalesce(F.col("reason"), F.when(F.col("text") == "", "empty_clean_text")))
    return t.select("ordinal", "split", "source_text_id", "text_id", F.expr("try_cast(image AS BIGINT)").alias("image_id"), F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "reason")


def parsed_scene_captions(lines: DataFrame, split_images: DataFrame, splits: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """Lines (ordinal, line) `image#n TAB text` with split_images (split, position, source_id).

    (ordinal, source_text_id, source_id, split, text_id, text, reason). Reasons in order:
    malformed_caption, duplicate_caption_id (of lines that could be mapped), caption_without_split_mapping;
    text_id counts from 1 over splits, images and captions in order, those empty after
    cleaning too (empty_clean_text).
    """
    head, rest = F.regexp_extract("line", r"(?s)^([^\t]*)\t(.*)$", 1), F.regexp_extract("line", r"(?s)^([^\t]*)\t(.*)$", 2)
    t = lines.select("ordinal", head.alias("source_text_id"), rest.alias("raw"), (F.col("line").contains("\t") & head.contains("#")).alias("formed"))
    t = t.withColumn("source_id", F.when(F.col("formed"), F.regexp_extract("source_text_id", r"(?s)^(.*)#[^#]*$", 1))).withColumn("n", F.regexp_extract("source_text_id", r"#([^#]*)$", 1))
    t = salted_join(t, split_images.select("split", "position", "source_id"), ["source_id"], "ordinal", how="left")
    ok = F.col("formed") & F.col("split").isNotNull() & F.col("n").rlike("^[0-9]+$")
    t = _first_wins(t.withColumn("_ok", ok).withColumn("_k", F.when(ok, F.col("source_text_id"))), ["_k"], "ordinal", "_one")
    t = t.withColumn("reason", F.when(~F.col("formed"), "malformed_caption").when(F.col("_ok") & ~F.col("_one"), "duplicate_caption_id").when(~F.col("_ok"), "caption_without_split_mapping"))
    t = cut(t, "scenes")
    kept = t.where("reason IS NULL").withColumn("text", normalized(F.col("raw"))).withColumn("reason", F.when(F.col("text") == "", "empty_clean_text"))
    rank = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")) - 1
    kept = kept.withColumn("_r", rank)
    kept = cut(dense_ids(kept, "ordinal", "_c", ["_r", "position"]), "scenes")  # the captions of one image, a hot one in parts
    per = kept.groupBy("_r", "position").agg(F.count("*").alias("_n")).withColumn("_o", F.col("_r") * (1 << 40) + F.col("position"))
    starts = running(per, "_o", F.col("_n"), "_start").select("_r", "position", "_start")
    kept = salted_join(kept, starts, ["_r", "position"], "ordinal").withColumn("text_id", F.col("_start") + F.col("_c") + 1)
    good = kept.select("ordinal", "source_text_id", "source_id", "split", "text_id", F.when(F.col("reason").isNull(), F.col("text")).alias("text"), "reason")
    rest_rows = t.where("reason IS NOT NULL").select("ordinal", "source_text_id", "source_id", "split", F.lit(None).cast("bigint").alias("text_id"), F.lit(None).cast("string").alias("text"), "reason")
    return good.unionByName(rest_rows)


def keep_first(df: DataFrame, keys: list[str], order: str, only: Column | None = None) -> DataFrame:
    """The first row of each key, by order; with `only`, rows for which it does not hold all stay.

    Null keys are equal to each other. No window: a key of any frequency is met by a partial
    aggregate and an equi-join back.
    """
    scope = df if only is None else df.where(only)
    first = scope.groupBy(*keys).agg(F.min(order).alias(order)).select(order)
    kept = scope.join(first, order, "left_semi")
    return kept if only is None else kept.unionByName(df.where(~F.coalesce(only, F.lit(False))))


def issue_samples(issues: DataFrame, reason: str = "reason", order: str = "ordinal", n: int = 5) -> DataFrame:
    """(reason, total, rank, order) of the first n issues of each reason, with the total."""
    totals = issues.groupBy(reason).agg(F.count("*").alias("total"))
    w = Window.partitionBy(reason).orderBy(order)
    first = issues.select(reason, order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return first.join(totals, reason).select(reason, "total", "rank", order)


def floor_index_percentiles(df: DataFrame, keys: list[str], value: str, ratios: dict[str, float]) -> DataFrame:
    """Per keys count, min, truncated median, the element at floor((n-1) ratio) of the sorted values, and max.

    Values are counted first, so a window sees one row per distinct value of a key, not per row.
    """
    h = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(value)
    h = h.withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col(value)))

    n = F.col("_all")
    cols = [F.max("_all").alias("n"), F.min(value).alias("min"), F.floor((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).cast("int").alias("p50")]
    cols += [at(F.floor((n - 1) * r)).alias(name) for name, r in ratios.items()]
    return h.groupBy(*keys).agg(*cols, F.max(value).alias("max"))


def preparation_faults(captions: DataFrame, images: DataFrame, item: str = "item_id") -> DataFrame:
    """(rule, key) of what stops a preparation run: captions (item, image_id) against decoded images (image_id, status).

    `missing image`: a caption's image has no kept payload; `undecodable`: a malformed line of a
    needed image; `repeated item`: an item id twice. No rows means the run may go on.
    """
    kept = images.where("status = 'kept'").select("image_id")
    lost = captions.select("image_id").distinct().join(kept, "image_id", "left_anti")
    bad = images.where("status = 'malformed' AND image_id IS NOT NULL").select("image_id").distinct().join(captions.select("image_id").distinct(), "image_id", "left_semi")
    again = captions.where(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("n")).where("n > 1")
    return (
        lost.select(F.lit("missing image").alias("rule"), F.col("image_id").cast("string").alias("key"))
        .unionByName(bad.select(F.lit("undecodable").alias("rule"), F.col("image_id").cast("string").alias("key")))
        .unionByName(again.select(F.lit("repeated item").alias("rule"), F.col(item).cast("string").alias("key")))
    )
