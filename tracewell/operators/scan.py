"""Running state over an ordered sequence whose one key may hold all rows.

A window over a key puts the key's rows into one task. Here the order is cut into ranges at quantiles of
the whole table; each (key, range) is scanned by itself, leaves a summary, and starts with what the key's
earlier ranges left. Only summaries, RANGES for each key at most, meet in a key's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 256


def range_of(rows: DataFrame, order: str, ranges: int = RANGES) -> Column:
    """The range that a row's place in the order falls into; rows without a place come first."""
    cuts = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 100 * ranges).alias("cuts")).first()["cuts"] or []
    return F.coalesce(F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c <= F.col(order))), F.lit(0)) if cuts else F.lit(0)


def carried(rows: DataFrame, keys: list[str], order: str, value: Column, to: str, own: bool = True, ranges: int = RANGES) -> DataFrame:
    """rows with the last value, up to each row (or before it, unless ``own``), that isn't null within its keys; order: a number.

    Null keys are keys like others; of rows in one place any one is the first. An empty table stays empty.
    """
    cut = rows.withColumn("__range", range_of(rows, order, ranges)).withColumn("__value", value)
    inside = W.partitionBy(*keys, "__range").orderBy(order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    local = cut.withColumn("__local", F.last("__value", ignorenulls=True).over(inside))
    # what each range leaves: its last value
    every = cut.groupBy(*keys, "__range").agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(order, "__value"))).alias("__left"))
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = every.select(*(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), F.col("__range").alias("__r"), F.last("__left", ignorenulls=True).over(before).alias("__start"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{n}")) for n, k in enumerate(keys)] + [F.col("__range") == F.col("__r")]
    joined = local.join(starts, same, "left")
    return joined.select(*rows.columns, F.coalesce("__local", "__start").alias(to))
