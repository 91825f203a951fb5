"""Ranges of time: a key with most of the rows is cut into ranges that hold about as many rows each, and what a range needs from those before it is carried in.

The cuts are quantiles of the times of all rows, a few values that stand in the plan; rows
of one time are never parted. A range sends one row for each of its keys ahead, so what is
carried is as many rows as there are keys and ranges, and no task needs a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding


def default_ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cuts(times: DataFrame, on: str, n: int) -> list:
    """At most n - 1 times that cut the rows into about equal parts: a job of its own, of which these few values come back."""
    if n < 2:
        return []
    return sorted(set(times.agg(F.percentile_approx(on, [k / n for k in range(1, n)], 10_000)).first()[0] or ()))


def with_range(df: DataFrame, on: str, at: list, out: str = "range_") -> DataFrame:
    """Adds the number of the range (from 0) that a time falls into; a null time into the first."""
    if not at:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, F.coalesce(F.size(F.filter(F.array(*[F.lit(v) for v in at]), lambda x: x < F.col(on))), F.lit(0)))


def carried(ranged: DataFrame, by: Sequence[str], of: dict[str, Column], after: dict[str, Column]) -> DataFrame:
    """``ranged`` (by, range_) with columns made of earlier ranges of its key: ``of`` are aggregates of a range, ``after`` window functions of these over the earlier ranges."""
    ends = ranged.groupBy(*by, "range_").agg(*[c.alias(k) for k, c in of.items()])
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("range_").rowsBetween(FIRST, -1)  # a row for each range
    ends = ends.select(*[F.col(k).alias(f"of_{k}") for k in by], F.col("range_").alias("of_range_"), *[c.over(w).alias(k) for k, c in after.items()])
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*by, "range_"]]  # from plain equality the optimizer would infer a filter of times on the side that has none
    return ranged.join(ends, same, "left").drop(*[f"of_{k}" for k in by], "of_range_")


def drawdowns(series: DataFrame, by: Sequence[str], value: str = "portfolio_value", on: str = "date", ranges: int | None = None) -> DataFrame:
    """by, hi, lo, max_drawdown (percent): each range gives its highest and lowest value and its own drawdown; these merge in order.

    Of a range behind a peak p the drawdown is the less of its own and of (lowest - p) / p, so two neighbours merge into (higher high,
    lower low, least of both and of the second's low under the first's high). Values are positive.
    """
    n = ranges or default_ranges(series)
    x = series.where(F.col(value).isNotNull()).select(*by, on, F.col(value).cast("double").alias("v_"))
    x = with_range(x, on, cuts(x, on, n))
    peak = F.max("v_").over(Window.partitionBy(*by, "range_").orderBy(on).rangeBetween(FIRST, 0))
    parts = x.withColumn("own_", (F.col("v_") - peak) / peak * 100).groupBy(*by, "range_").agg(F.max("v_").alias("hi"), F.min("v_").alias("lo"), F.min("own_").alias("own_"))
    before = F.max("hi").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("range_").rowsBetween(FIRST, -1))  # a row for each range
    parts = parts.withColumn("own_", F.least("own_", (F.col("lo") - before) / before * 100))
    return parts.groupBy(*by).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.min("own_").alias("max_drawdown"))
