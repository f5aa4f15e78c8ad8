"""Batch masks and contrastive losses in SQL terms.

A batch is a bounded set of texts and images (one training step), so its pairs are as well.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.functions import vectors


def positive_mask(texts: DataFrame, images: DataFrame, edges: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, text_uid, image_uid, positive) of all pairs of each batch; positive if related in either direction."""
    both = edges.select("text_uid", "image_uid").distinct().withColumn("_p", F.lit(True))
    pairs = texts.select(batch, "text_uid").distinct().join(images.select(batch, "image_uid").distinct(), batch)
    return pairs.join(both, ["text_uid", "image_uid"], "left").select(batch, "text_uid", "image_uid", F.coalesce("_p", F.lit(False)).alias("positive"))


def bare_anchors(mask: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, axis, uid) of texts and images that have no positive in their batch."""
    out = None
    for axis, uid in (("text", "text_uid"), ("image", "image_uid")):
        g = mask.groupBy(batch, uid).agg(F.bool_or("positive").alias("p")).where("NOT p").select(batch, F.lit(axis).alias("axis"), F.col(uid).alias("uid"))
        out = g if out is None else out.unionByName(g)
    return out


def multi_positive_loss(logits: DataFrame, anchor: str, keys: list[str] | None = None, strict: bool = True) -> DataFrame:
    """Per anchor logsumexp(all logits) - logsumexp(positive logits), in two stable passes.

    logits (keys, anchor, logit, positive). An anchor without positive fails the job when it is
    read, unless strict is off, when it is left out (bare_anchors lists them).
    """
    keys = keys or []
    top = logits.groupBy(*keys, anchor).agg(F.max("logit").alias("_m"))
    g = logits.join(top, [*keys, anchor]).withColumn("_e", F.exp(F.col("logit") - F.col("_m"))).groupBy(*keys, anchor).agg(F.sum("_e").alias("_all"), F.sum(F.when(F.col("positive"), F.col("_e"))).alias("_pos"))
    if strict:
        refused = F.raise_error(F.concat(F.lit("no positive for anchor "), F.col(anchor).cast("string"))).cast("double")
        return g.select(*keys, anchor, F.when(F.col("_pos").isNull(), refused).otherwise(F.log("_all") - F.log("_pos")).alias("loss"))
    return g.where("_pos IS NOT NULL").select(*keys, anchor, (F.log("_all") - F.log("_pos")).alias("loss"))


def reduced(losses: DataFrame, how: str, keys: list[str] | None = None) -> DataFrame:
    """None, mean or sum of the losses."""
    if how == "none":
        return losses
    if how not in ("mean", "sum"):
        raise ValueError("reduction must be none, mean or sum")
    return losses.groupBy(*(keys or [])).agg((F.avg if how == "mean" else F.sum)("loss").alias("loss"))


def scaled_logits(texts: DataFrame, images: DataFrame, edges: DataFrame, logit_scale: float, batch: str = "batch") -> DataFrame:
    """(batch, text_uid, image_uid, logit, positive): inner products of unit vectors times exp(logit_scale), for all pairs of a batch.

    texts (batch, text_uid, v), images (batch, image_uid, v); vectors are normalised here.
    """
    mask = positive_mask(texts, images, edges, batch)
    t = texts.select(batch, "text_uid", vectors.unit(F.col("v")).alias("_t"))
    i = images.select(batch, "image_uid", vectors.unit(F.col("v")).alias("_i"))
    return mask.join(t, [batch, "text_uid"]).join(i, [batch, "image_uid"]).select(batch, "text_uid", "image_uid", (vectors.dot(F.col("_t"), F.col("_i")) * math.exp(logit_scale)).alias("logit"), "positive")


def symmetric_loss(logits: DataFrame, batch: str = "batch", strict: bool = True) -> DataFrame:
    """(batch, text_loss, image_loss, loss): mean loss of both directions and their mean."""
    t = reduced(multi_positive_loss(logits, "text_uid", [batch], strict), "mean", [batch]).withColumnRenamed("loss", "text_loss")
    i = reduced(multi_positive_loss(logits, "image_uid", [batch], strict), "mean", [batch]).withColumnRenamed("loss", "image_loss")
    return t.join(i, batch).withColumn("loss", (F.col("text_loss") + F.col("image_loss")) / 2)


def parameter_counts(params: DataFrame, group: str = "group", numel: str = "numel", trainable: str = "trainable") -> DataFrame:
    """Per optimiser group the parameters, trainable ones, and their share in percent; `all` for the whole."""
    per = params.groupBy(group).agg(F.sum(numel).alias("parameters"), F.sum(F.when(F.col(trainable), F.col(numel)).otherwise(0)).alias("trainable"))
    both = per.unionByName(per.agg(F.sum("parameters").alias("parameters"), F.sum("trainable").alias("trainable")).select(F.lit("all").alias(group), "parameters", "trainable"))
    return both.withColumn("percent", F.col("trainable") * 100 / F.col("parameters"))
