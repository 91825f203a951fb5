"""Indicators of tickers of any length: the bars of a ticker are cut into lanes, and no task needs more than one of them.

A bar's number comes from counts by range of time. Windows of bounded reach see the last
bars of the lane before as a halo. Exponential means are affine in what a lane starts
from: a lane's own sum and its decay make a map, maps of lanes compose to what the next
one starts from, and that is added to each of its bars. The functions of ``indicators``
do the rest, with a lane in place of a ticker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import indicators as I
from .ranges import carried, cuts, default_ranges, with_range

SIZE = 4096


def numbered(bars: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds ``i`` as ``indicators.numbered`` does, from the place in a range of time and the counts of the ranges before."""
    x = bars.where("close is not null")
    x = with_range(x, "date", cuts(x, "date", ranges or default_ranges(bars)))
    x = carried(x, ["ticker"], {"n_": F.count("*")}, {"before_": F.sum("n_")})
    own = F.row_number().over(Window.partitionBy("ticker", "range_").orderBy("date")) - 1
    return x.withColumn("i", (own + F.coalesce("before_", F.lit(0))).cast("long")).drop("range_", "before_")


def lanes(bars: DataFrame, reach: int, size: int) -> DataFrame:
    """Bars by lane: ``ticker`` becomes (ticker, lane), and the last ``reach`` bars before a lane stand in it too, with ``core_`` false."""
    own = F.floor(F.col("i") / size)
    x = bars.withColumn("lane_", F.explode(F.sequence(own, F.floor((F.col("i") + reach) / size))))
    return x.withColumns({"core_": F.col("lane_") == own, "ticker": F.struct("ticker", F.col("lane_").alias("lane"))}).drop("lane_")


def whole(bars: DataFrame) -> DataFrame:
    """The bars of ``lanes`` without halo, by ticker again."""
    return bars.where("core_").withColumn("ticker", F.col("ticker.ticker")).drop("core_")


def _mean(size: int):
    def exponential(bars: DataFrame, x: Column, decay: float, out: str) -> DataFrame:
        """As ``indicators.exponential``, over all lanes of a ticker."""
        bars = I.exponential(bars, F.when(F.col("core_"), x), decay, out)
        ends = bars.where("core_").groupBy("ticker").agg(F.max_by(out, "i").alias("end_")).select(F.col("ticker.ticker").alias("ticker"), F.col("ticker.lane").alias("i"), "end_")
        ends = I.exponential(ends, F.col("end_"), max(decay**size, 1e-300), "start_")  # lane by lane: the whole of one counts after the decay of the next
        ends = ends.select(F.struct("ticker", (F.col("i") + 1).alias("lane")).alias("of_"), "start_")
        bars = bars.join(ends, F.col("ticker") == F.col("of_"), "left").drop("of_")
        age = F.col("i") - F.col("ticker.lane") * size + 1
        return bars.withColumn(out, F.col(out) + F.coalesce("start_", F.lit(0.0)) * F.pow(F.lit(decay), age)).drop("start_")

    return exponential


def indicators(bars: DataFrame, percentile: bool = False, size: int = SIZE, ranges: int | None = None, **params) -> DataFrame:
    """The columns of ``indicators.indicators``."""
    p, mean = I.PARAMS | params, _mean(size)
    x = lanes(numbered(bars, ranges), 1, size)
    x = whole(I.atr(I.rsi(x, p["rsi_period"], mean=mean), p["atr_period"], mean=mean))
    reach = max(p["volume_period"], p["bb_period"], p["mr_period"], p["williams_period"], p["stoch_period"] + p["smooth_k"] + p["smooth_d"], p["atr_lookback"] if percentile else 0)
    return whole(I.windowed(lanes(x, reach, size), percentile, p))
