"""Expressions for behaviour scores and value clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartlens import constants as C


def action_weight(action: str) -> Column:
    """Weight of an action; unknown or missing actions weigh 0."""
    name = F.lower(action)
    first, *rest = C.ACTION_WEIGHTS.items()
    chain = reduce(
        lambda expr, pair: expr.when(name == pair[0], float(pair[1])),
        rest,
        F.when(name == first[0], float(first[1])),
    )
    return chain.otherwise(0.0)


def dwell_bonus(seconds: str) -> Column:
    """Bonus for time spent, capped from above only; a missing time counts as 0."""
    steps = F.coalesce(F.col(seconds), F.lit(0.0)) / C.DWELL_STEP_SEC
    return F.least(steps, F.lit(float(C.DWELL_MAX_STEPS))) * C.DWELL_STEP_BONUS


def event_score(action: str = "action", seconds: str = "duration_sec") -> Column:
    return action_weight(action) + dwell_bonus(seconds)


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Cut to ``low..high``; a null stays null, which ``least`` alone would replace."""
    cut = value
    if high is not None:
        cut = F.least(cut, F.lit(high))
    if low is not None:
        cut = F.greatest(cut, F.lit(low))
    return F.when(value.isNotNull(), cut)


def guarded_ratio(numerator: Column, count: Column) -> Column:
    """``numerator / count`` where ``count`` is positive, else 0."""
    return F.when(count > 0, numerator / count).otherwise(0.0)


def hash_bucket(salt: str, buckets: Column | int, *keys: Column) -> Column:
    """Stable bucket of a key: the first 32 bits of an md5, modulo ``buckets``."""
    text = F.concat_ws(":", F.lit(salt), *keys)
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return head % (F.lit(buckets) if isinstance(buckets, int) else buckets)
