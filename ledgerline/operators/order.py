"""Order statistics without a task that holds all values.

Values are cut into ranges; a range's count is a row, so the places of its values follow
from the counts before it. A quantile looks into the one or two ranges that hold its
place and nowhere else; ranks need every range, each by itself. Equal values count as
one, whatever their number.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import kept
from .ranges import FIRST, carried, cuts, default_ranges, with_range


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with its keys under names that meet null-safe."""
    return df.withColumnsRenamed({k: f"of_{k}" for k in by}), [f"of_{k}" for k in by]


def meet(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; one row on the right if there are none."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row
    other, names = _keyed(right, by)
    return left.join(other, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names, strict=True)], how).drop(*names)


def counted(df: DataFrame, column: str, by: Sequence[str] = (), extra: Mapping[str, Column] | None = None, ranges: int | None = None) -> DataFrame:
    """by, v_, c_, before_: each distinct value with its number of rows and the number of rows of lesser values; ``extra`` are sums of the value's rows."""
    x = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v_")).agg(F.count("*").alias("c_"), *[c.alias(k) for k, c in (extra or {}).items()])
    return placed(x, by, ranges)


def placed(x: DataFrame, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``x`` (by, v_, c_), a row for each distinct value, with before_: the sum of c_ of lesser values."""
    x = kept(x, "counted")  # read for the cuts, for the sums before a range and in it
    x = with_range(x, "v_", cuts(x, "v_", ranges or default_ranges(x)))
    x = carried(x, by, {"sum_": F.sum("c_")}, {"before_": F.sum("sum_")})
    lesser = F.sum("c_").over(Window.partitionBy(*by, "range_").orderBy("v_").rowsBetween(FIRST, -1))
    return x.withColumn("before_", F.coalesce("before_", F.lit(0)) + F.coalesce(lesser, F.lit(0))).drop("range_")


def quantiles(df: DataFrame, column: str, shares: Mapping[str, float], by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """by and a column for each named share: the exact quantile, linear between neighbours; null without values."""
    x = kept(df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v_")), "values")  # read for the cuts, the histogram and the ranges wanted
    x = with_range(x, "v_", cuts(x, "v_", ranges or default_ranges(df)))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    bars = x.groupBy(*by, "range_").agg(F.count("*").alias("c_"))  # the histogram: a row for each key and range
    bars = bars.withColumns({"before_": F.coalesce(F.sum("c_").over(w.orderBy("range_").rowsBetween(FIRST, -1)), F.lit(0)), "n_": F.sum("c_").over(w)})
    at = {k: (F.col("n_") - 1) * q for k, q in shares.items()}
    places = [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), f(p).cast("long").alias("place"), (p - F.floor(p)).alias("part")) for k, p in at.items() for side, f in ((0, F.floor), (1, F.ceil))]
    wanted = bars.select(*by, "range_", "before_", "c_", F.explode(F.array(*places)).alias("w_")).where((F.col("w_.place") >= F.col("before_")) & (F.col("w_.place") < F.col("before_") + F.col("c_"))).drop("c_")
    keys = [*by, "range_"]
    there, names = _keyed(wanted.select(*keys).distinct(), keys)
    inside = x.join(there, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)], "left_semi").groupBy(*keys, "v_").agg(F.count("*").alias("c_"))
    inside = inside.withColumn("upto_", F.sum("c_").over(Window.partitionBy(*keys).orderBy("v_").rowsBetween(FIRST, 0)))
    found = meet(inside, wanted, keys).where((F.col("w_.place") < F.col("before_") + F.col("upto_")) & (F.col("w_.place") >= F.col("before_") + F.col("upto_") - F.col("c_")))

    def value(k: str) -> Column:
        side = lambda s: F.max(F.when((F.col("w_.k") == k) & (F.col("w_.side") == s), F.col("v_")))
        part = F.max(F.when(F.col("w_.k") == k, F.col("w_.part")))
        return side(0) * (1 - part) + side(1) * part

    return found.groupBy(*by).agg(*[value(k).alias(k) for k in shares])


def average_ranks(df: DataFrame, column: str, out: str, ranges: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """``df`` with ranks from 1, ties at their mean; null stays null. ``of``: the rows the ranks are among, where ``df`` is these with more columns."""
    ranks = counted(df if of is None else of, column, ranges=ranges).select("v_", (F.col("before_") + (F.col("c_") + 1) / 2).alias(out))
    return df.join(ranks, F.col(column).cast("double") == F.col("v_"), "left").drop("v_")


def trimmed_mean(df: DataFrame, column: str, share: float, ranges: int | None = None) -> DataFrame:
    """n and the mean without int(share * n) of the smallest and of the largest."""
    x = counted(df, column, ranges=ranges)
    x = x.crossJoin(F.broadcast(x.agg(F.sum("c_").alias("n"))))  # one row
    cut = F.floor(F.col("n") * share)
    kept = F.greatest(F.least(F.col("before_") + F.col("c_"), F.col("n") - cut) - F.greatest(F.col("before_"), cut), F.lit(0))
    return x.agg(F.max("n").alias("n"), (F.sum(kept * F.col("v_")) / F.sum(kept)).alias("trimmed"))


def running(df: DataFrame, order: str, value: str, out: str, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to its own, by ``order`` and then ``ties``."""
    x = with_range(df, order, cuts(df, order, ranges or default_ranges(df)))
    x = carried(x, [], {"sum_": F.sum(value)}, {"before_": F.sum("sum_")})
    upto = F.sum(value).over(Window.partitionBy("range_").orderBy(order, *ties).rowsBetween(FIRST, 0))
    return x.withColumn(out, upto + F.coalesce("before_", F.lit(0))).drop("range_", "before_")
