"""Synthetic bars: random walks that any engine can repeat, from integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODULUS = 2_147_483_648


def noise(a: Column, b: Column, seed: int) -> Column:
    """A number in [-1, 1) of two integers and a seed: two rounds of a linear congruence."""
    once = ((a * 7919 + b * 104729 + seed) * 1103515245 + 12345) % MODULUS
    twice = ((once + F.floor(once / 65536)) * 1103515245 + 12345) % MODULUS
    return twice / (MODULUS / 2) - 1


def random_walk(spark: SparkSession, tickers: int = 25, days: int = 1000, seed: int = 7, start: str = "2015-01-01", volume: float = 1_000_000.0) -> DataFrame:
    """Bars on five days of each seven: closes grow by up to 3 % either way a day, opens gap by up to 1 %, ranges are up to 2 % wide."""
    cells = spark.range(tickers).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(days - 1).cast("long"))).alias("n"))
    step = lambda shift: noise(F.col("k"), F.col("n"), seed + shift)
    grown = F.sum(F.log1p(0.03 * step(0))).over(Window.partitionBy("k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    x = cells.withColumn("close", F.round(100 * F.exp(grown), 4))
    x = x.withColumn("open", F.round(F.coalesce(F.lag("close").over(Window.partitionBy("k").orderBy("n")), F.lit(100.0)) * (1 + 0.01 * step(1)), 4))
    high, low = F.greatest("open", "close"), F.least("open", "close")
    x = x.withColumns({"high": F.round(high * (1 + 0.01 * F.abs(step(2))), 4), "low": F.round(low * (1 - 0.01 * F.abs(step(3))), 4), "volume": F.floor(volume * (1 + 0.5 * step(4))).cast("double")})
    date = F.date_add(F.lit(start).cast("date"), (F.floor(F.col("n") / 5) * 7 + F.col("n") % 5).cast("int"))
    return x.select(F.format_string("T%03d", "k").alias("ticker"), date.alias("date"), "open", "high", "low", "close", "volume")
