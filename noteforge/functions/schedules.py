"""Schedules and batch arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """linear from 0 to 1 over the warm-up steps, then half a cosine down to 0."""
    rising = step.cast("double") / max(1, warmup)
    at = (step - warmup).cast("double") / max(1, total - warmup)
    return F.when(step < warmup, rising).otherwise(F.greatest(F.lit(0.0), (F.cos(F.lit(math.pi) * F.least(at, F.lit(1.0))) + 1) * 0.5))


def group_size(batch: Column, batches: int, per_step: int) -> Column:
    """batches in the accumulation group of a batch (0-based); the last group has the remainder."""
    start = F.floor(batch / per_step) * per_step
    return F.least(F.lit(per_step), F.lit(batches) - start).cast("int")


def optimizer_steps(batches: Column, per_step: Column) -> Column:
    """steps of an epoch, counting an incomplete last group."""
    return F.ceil(batches / per_step).cast("bigint")


def batch_number(position: Column, size: int) -> Column:
    """0-based batch of a 0-based position."""
    return F.floor(position / size).cast("bigint")
