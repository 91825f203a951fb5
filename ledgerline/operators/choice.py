"""Correlated pairs of tickers, and the greedy choice under limits.

Return vectors that point nearly the same or the opposite way lie on the same sides of
most random planes: those that share a band of sides are candidates, and only for these
the exact correlation over common dates is computed. The choice walks the candidates of
a date from the best down in one expression, all dates at once; its state is what has
been chosen.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS, BITS = 24, 4


def recall(limit: float, bands: int = BANDS, bits: int = BITS) -> float:
    """Chance that a pair of vectors at a correlation of ``limit`` (or of minus that) over the same dates becomes a candidate."""
    same = 1 - math.acos(limit) / math.pi
    return 1 - (1 - same**bits - (1 - same) ** bits) ** bands


def sides(returns: DataFrame, bands: int, bits: int, seed: int, key: str, on: str, value: str) -> DataFrame:
    """key, band, side: the sides that the standardised returns lie on, ``bits`` planes a band; a band and its mirror image are one."""
    own = returns.where(F.col(value).isNotNull())
    mean = own.groupBy(key).agg(F.avg(value).alias("mean_"))
    x = own.join(mean, key).withColumn("z_", F.col(value) - F.col("mean_"))
    sign = lambda k: 1 - 2 * F.getbit(F.xxhash64(F.lit(seed), F.lit(k), F.col(on)), F.lit(0))
    bit = lambda k: (F.sum(F.col("z_") * sign(k)) >= 0).cast("int")
    found = x.groupBy(key).agg(*[F.array(*[bit(b * bits + j) for j in range(bits)]).alias(f"b{b}") for b in range(bands)])
    long = found.select(key, F.posexplode(F.array(*[f"b{b}" for b in range(bands)])).alias("band", "bits"))
    return long.select(key, "band", F.transform("bits", lambda v: F.abs(v - F.get("bits", F.lit(0)))).alias("side"))


def candidates(returns: DataFrame, bands: int = BANDS, bits: int = BITS, seed: int = 7, key: str = "ticker", on: str = "date", value: str = "r") -> DataFrame:
    """a, b: pairs that share a band, a before b."""
    x = sides(returns, bands, bits, seed, key, on, value)
    a, b = x.withColumnRenamed(key, "a"), x.withColumnRenamed(key, "b")
    return a.join(b, ["band", "side"]).where("a < b").select("a", "b").distinct()


def correlated(returns: DataFrame, limit: float, min_obs: int = 20, exact: bool = False, bands: int = BANDS, bits: int = BITS, seed: int = 7, key: str = "ticker", on: str = "date", value: str = "r") -> DataFrame:
    """a, b, n, corr of the pairs beyond ``limit`` either way (all pairs that meet, if it is negative), over at least ``min_obs`` common dates.

    ``exact`` meets every pair of tickers of a date; else only candidates meet, of which a pair at the limit is one with the chance
    that ``recall`` gives (a stronger pair with more), if both have the same dates.
    """
    x = returns.where(F.col(value).isNotNull()).select(key, on, F.col(value).cast("double").alias("v_"))
    a, b = (x.select(F.col(key).alias(n), on, F.col("v_").alias(f"v_{n}")) for n in "ab")
    met = a.join(b, on).where("a < b") if exact else candidates(returns, bands, bits, seed, key, on, value).join(a, "a").join(b, ["b", on])
    c = met.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("v_a", "v_b").alias("corr"))
    return c.where((F.col("n") >= min_obs) & ((F.abs("corr") > limit) if limit >= 0 else F.lit(True)))


def greedy(candidates_: DataFrame, top_n: int, max_per_sector: int | None = None, conflicts: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """candidates(date, ticker, score, sector) -> date, place, ticker: the best first (ties by name) while there are slots.

    One is passed over if ``max_per_sector`` of its sector are in, or if it is in conflict (a, b, and a date if they differ by date) with
    one that is in. ``held`` (date, ticker, sector) are in from the start and take slots. A missing sector is Unknown.
    """
    x = candidates_.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    if conflicts is not None:
        on = ["date"] if "date" in conflicts.columns else []
        both = conflicts.select(*on, "a", "b").unionByName(conflicts.select(*on, F.col("b").alias("a"), F.col("a").alias("b")))
        x = x.join(both.groupBy(*on, F.col("a").alias("ticker")).agg(F.collect_set("b").alias("against_")), [*on, "ticker"], "left")
    else:
        x = x.withColumn("against_", F.lit(None).cast("array<string>"))
    one = F.struct((-F.col("score").cast("double")).alias("order"), F.col("ticker").cast("string").alias("ticker"), "sector", F.coalesce("against_", F.array().cast("array<string>")).alias("against"))
    days = x.groupBy("date").agg(F.sort_array(F.collect_list(one)).alias("list_"))
    none = F.array().cast("array<string>")
    if held is not None:
        days = days.join(held.groupBy("date").agg(F.collect_list(F.col("ticker").cast("string")).alias("in_"), F.collect_list(F.coalesce("sector", F.lit("Unknown"))).alias("sectors_")), "date", "left")
    else:
        days = days.withColumns({"in_": none, "sectors_": none})
    start = F.struct(F.coalesce("in_", none).alias("names"), F.coalesce("sectors_", none).alias("sectors"))

    def step(s, c):
        fits = (F.size(s["names"]) < top_n) & ~F.arrays_overlap(s["names"], c["against"])
        if max_per_sector is not None:
            fits = fits & (F.size(F.filter(s["sectors"], lambda k: k == c["sector"])) < max_per_sector)
        return F.when(fits, F.struct(F.array_append(s["names"], c["ticker"]).alias("names"), F.array_append(s["sectors"], c["sector"]).alias("sectors"))).otherwise(s)

    names = F.aggregate("list_", start, step, lambda s: s["names"])
    before = F.size(F.coalesce("in_", none))
    chosen = days.select("date", F.slice(names, before + 1, F.size("list_")).alias("new_"))
    return chosen.select("date", F.posexplode("new_").alias("place", "ticker")).withColumn("place", F.col("place") + 1)
