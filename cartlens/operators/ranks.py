"""Global order statistics without a single-task sort.

A window without a partition key would pull the whole table into one task.
Here the key range is cut at approximate quantiles; each range is ranked on its
own and only the per-range totals, at most ``RANGES`` rows, are accumulated
centrally. The result is exact: the quantiles decide the balance, not the ranks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 200


def running_total(df: DataFrame, key: str, amount: str, ranges: int = RANGES) -> DataFrame:
    """Add ``running``: the sum of ``amount`` over all rows up to ``key`` (unique values)."""
    shares = [i / ranges for i in range(1, ranges)]
    kind = df.schema[key].dataType
    found = df.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []
    cuts = F.array(*map(F.lit, found)).cast(f"array<{kind.simpleString()}>")
    ranged = df.withColumn("_cuts", cuts).withColumn(
        "_range", F.size(F.filter("_cuts", lambda cut: cut < F.col(key)))
    ).drop("_cuts")

    # At most ``ranges`` numbers: what lies before each range.
    totals = {r["_range"]: r["_total"] for r in ranged.groupBy("_range").agg(F.sum(amount).alias("_total")).collect()}
    ahead = list(accumulate((totals.get(i) or 0 for i in range(len(found) + 1)), initial=0))
    offset = F.element_at(F.array(*map(F.lit, ahead)), F.col("_range") + 1)
    within = Window.partitionBy("_range").orderBy(key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        ranged.withColumn("_within", F.sum(amount).over(within))
        .withColumn("running", offset + F.col("_within"))
        .drop("_range", "_within")
    )


def dense_codes(ids: DataFrame, key: str, code: str = "code") -> DataFrame:
    """Codes 0, 1, 2, … of the distinct values of ``key`` in ascending order."""
    distinct = ids.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = running_total(distinct.withColumn("_one", F.lit(1).cast("long")), key, "_one")
    return ranked.select(key, (F.col("running") - 1).alias(code))


def exact_quantile(df: DataFrame, value: str, share: float, alias: str) -> DataFrame:
    """One row with the linearly interpolated quantile of the non-null values."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    position = share * (counts.agg(F.sum("_n")).scalar() - 1)
    ranked = running_total(counts, "_value", "_n").withColumn("_position", position)
    low, high = F.floor("_position"), F.ceil("_position")

    def at(rank):
        holds = (F.col("running") > rank) & (F.col("running") - F.col("_n") <= rank)
        return F.max(F.when(holds, F.col("_value")))

    return ranked.agg(
        at(low).alias("_low"),
        at(high).alias("_high"),
        F.max(F.col("_position") - low).alias("_part"),
    ).select((F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(alias))


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of each key; Spark cuts each task's share before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)
