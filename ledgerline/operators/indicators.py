"""Indicators of bars (ticker, date, open, high, low, close, volume) as causal windows.

Each function adds columns to the bars it gets. All windows are dealt by ticker, so one
shuffle serves them all. Rows without a close take no part. Exponential means are closed
sums, anchored anew before a power would overflow.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S

FIRST = Window.unboundedPreceding
PARAMS = {"rsi_period": 14, "bb_period": 20, "bb_std": 2.0, "mr_period": 252, "atr_period": 14, "volume_period": 20, "stoch_period": 14, "smooth_k": 3, "smooth_d": 3, "williams_period": 14, "atr_lookback": 252}


def by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def last_rows(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def numbered(bars: DataFrame) -> DataFrame:
    """Adds ``i``: the place of a bar among its ticker's, from 0."""
    return bars.where("close is not null").withColumn("i", (F.row_number().over(by_ticker()) - 1).cast("long"))


def full(x: Column, of: Column, n: int) -> Column:
    """``x`` where the last n rows all hold ``of``."""
    return F.when(F.count(of).over(last_rows(n)) == n, x)


def exponential(bars: DataFrame, x: Column, decay: float, out: str) -> DataFrame:
    """Adds the sum over all bars so far of ``x`` times decay to the power of its age."""
    block = max(1, int(150 / -math.log(decay)))
    r, power = F.col("i") % block, lambda n: F.pow(F.lit(decay), n)
    bars = bars.withColumn("block_", F.floor(F.col("i") / block))
    bars = bars.withColumn(out, F.sum(x * power(-r)).over(Window.partitionBy("ticker", "block_").orderBy("i").rowsBetween(FIRST, 0)) * power(r))
    carried = F.last(F.when(r == block - 1, F.col(out)), ignorenulls=True).over(Window.partitionBy("ticker").orderBy("i").rowsBetween(FIRST, -1))
    return bars.withColumn(out, F.col(out) + F.coalesce(carried, F.lit(0.0)) * power(r + 1)).drop("block_")


def rsi(bars: DataFrame, period: int = 14, out: str = "rsi", mean: Callable = exponential) -> DataFrame:
    """Wilder's: 50 while there are fewer than ``period`` changes, and where nothing has been lost."""
    decay = 1 - 1 / period
    bars = bars.withColumn("change_", F.col("close") - F.lag("close").over(by_ticker()))
    bars = mean(bars, F.greatest(F.col("change_"), F.lit(0.0)), decay, "gain_")
    bars = mean(bars, F.greatest(-F.col("change_"), F.lit(0.0)), decay, "loss_")
    value = F.when((F.col("i") < period) | (F.col("loss_") == 0), 50.0).otherwise(100 - 100 / (1 + F.col("gain_") / F.col("loss_")))
    return bars.withColumn(out, value).drop("change_", "gain_", "loss_")


def true_range() -> Column:
    before = F.lag("close").over(by_ticker())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(bars: DataFrame, period: int = 14, out: str = "atr", mean: Callable = exponential) -> DataFrame:
    """Exponential mean of the true range over a span; the first range weighs in full."""
    alpha = 2 / (period + 1)
    bars = mean(bars.withColumn("tr_", true_range()), F.when(F.col("i") == 0, 1.0).otherwise(alpha) * F.col("tr_"), 1 - alpha, out)
    return bars.withColumn(out, F.when(F.col("i") >= period - 1, F.col(out))).drop("tr_")


def bollinger(bars: DataFrame, period: int = 20, width: float = 2.0) -> DataFrame:
    """sma, upper, lower, pct_b; null until there are ``period`` bars, pct_b also where nothing moves."""
    mean, sd = (full(f("close").over(last_rows(period)), F.col("close"), period) for f in (F.avg, F.stddev_samp))
    bars = bars.withColumns({"sma": mean, "sd_": sd})
    bars = bars.withColumns({"upper": F.col("sma") + width * F.col("sd_"), "lower": F.col("sma") - width * F.col("sd_")})
    return bars.withColumn("pct_b", F.try_divide(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))).drop("sd_")


def zscore(bars: DataFrame, period: int = 252, out: str = "z_score") -> DataFrame:
    """Distance from the mean of the last ``period`` bars, or of all while there are fewer, in standard deviations."""
    w = last_rows(period)
    return bars.withColumn(out, F.try_divide(F.col("close") - F.avg("close").over(w), F.stddev_samp("close").over(w)))


def stoch_rsi(bars: DataFrame, period: int = 14, smooth_k: int = 3, smooth_d: int = 3, of: str = "rsi") -> DataFrame:
    """stoch_k, stoch_d of a column that holds the RSI."""
    w = last_rows(period)
    lo, hi = F.min(of).over(w), F.max(of).over(w)
    bars = bars.withColumn("raw_", full(F.try_divide(F.col(of) - lo, hi - lo), F.col(of), period))
    bars = bars.withColumn("stoch_k", full(F.avg("raw_").over(last_rows(smooth_k)), F.col("raw_"), smooth_k))
    return bars.withColumn("stoch_d", full(F.avg("stoch_k").over(last_rows(smooth_d)), F.col("stoch_k"), smooth_d)).drop("raw_")


def williams_r(bars: DataFrame, period: int = 14) -> DataFrame:
    w = last_rows(period)
    hi, lo = F.max("high").over(w), F.min("low").over(w)
    return bars.withColumn("williams_r", full(-100 * F.try_divide(hi - F.col("close"), hi - lo), F.col("close"), period))


def average_volume(bars: DataFrame, period: int = 20) -> DataFrame:
    """avg_volume (null until there are ``period`` bars) and vol_ratio (1 where the mean is 0)."""
    bars = bars.withColumn("avg_volume", full(F.avg("volume").over(last_rows(period)), F.col("volume"), period))
    return bars.withColumn("vol_ratio", F.when(F.col("avg_volume").isNotNull(), S.volume_ratio(F.col("volume"), F.col("avg_volume"))))


def atr_percentile(bars: DataFrame, lookback: int = 252) -> DataFrame:
    """Share of the last ATRs that do not exceed the present one, in percent, and its regime."""
    seen = F.collect_list("atr").over(last_rows(lookback))
    bars = bars.withColumn("seen_", seen)
    share = F.size(F.filter("seen_", lambda x: x <= F.col("atr"))) / F.size("seen_") * 100
    bars = bars.withColumn("atr_percentile", F.when(F.col("atr").isNotNull(), share)).drop("seen_")
    return bars.withColumn("atr_regime", S.atr_regime(F.col("atr_percentile")))


def indicators(bars: DataFrame, percentile: bool = False, **params) -> DataFrame:
    """All of them, with ``i``; the ATR percentile, which holds a year of ATRs for each bar, only if asked for."""
    p = PARAMS | params
    return windowed(atr(rsi(numbered(bars), p["rsi_period"]), p["atr_period"]), percentile, p)


def windowed(bars: DataFrame, percentile: bool, p: dict) -> DataFrame:
    """The indicators that look a bounded number of bars back, of bars with rsi and atr."""
    x = zscore(bollinger(average_volume(bars, p["volume_period"]), p["bb_period"], p["bb_std"]), p["mr_period"])
    x = williams_r(stoch_rsi(x, p["stoch_period"], p["smooth_k"], p["smooth_d"]), p["williams_period"])
    return atr_percentile(x, p["atr_lookback"]) if percentile else x


def subscores(ind: DataFrame) -> DataFrame:
    c = F.col
    return ind.withColumns({"s_rsi": S.score_rsi(c("rsi")), "s_bb": S.score_bollinger(c("pct_b")), "s_mr": S.score_mean_reversion(c("z_score")), "s_stochrsi": S.score_stoch_rsi(c("stoch_k")), "s_williams": S.score_williams(c("williams_r"))})


def lookback(bars: DataFrame, n: int = 320) -> DataFrame:
    """The last n bars of each ticker."""
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return bars.withColumn("back_", back).where(f"back_ <= {n}").drop("back_")


def period_returns(series: DataFrame, value: str = "portfolio_value", by: list[str] = (), out: str = "ret") -> DataFrame:
    w = Window.partitionBy(*by).orderBy("date")
    return series.withColumn(out, F.col(value) / F.lag(value).over(w) - 1)


def drawdown(series: DataFrame, value: str = "portfolio_value", by: list[str] = (), out: str = "drawdown") -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(*by).orderBy("date").rowsBetween(FIRST, 0))
    return series.withColumn(out, (F.col(value) - peak) / peak * 100)


def extrema(history: DataFrame, order: int = 10, price: str = "price") -> DataFrame:
    """is_min, is_max: no neighbour within ``order`` bars is lower, or higher; plateaus and edges count."""
    w = by_ticker().rowsBetween(-order, order)
    return history.withColumns({"is_min": F.col(price) == F.min(price).over(w), "is_max": F.col(price) == F.max(price).over(w)})


def signal_events(history: DataFrame, threshold: float = 6.5, order: int = 10, tolerance: int = 5, weeks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """First bars of runs of signals, with a low nearby (hit_bottom), returns some weeks on, and the move to the next extremum."""
    w, price = by_ticker(), F.col("price")
    x = extrema(history, order).withColumn("signal_", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    ahead = F.first(F.when(F.col("is_min") | F.col("is_max"), price), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    kind = F.first(F.when(F.col("is_min"), "min").when(F.col("is_max"), "max"), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    x = x.withColumns({
        "hit_bottom": F.max(F.col("is_min").cast("int")).over(w.rowsBetween(-tolerance, tolerance)) == 1, "before_": F.lag("signal_", 1, False).over(w),
        "next_move": F.round((ahead - price) / price * 100, 1), "next_kind": kind,
    } | {f"ret_{k}w": F.round((F.lead("price", 5 * k).over(w) - price) / price * 100, 1) for k in weeks})
    return x.where("signal_ and not before_").select("ticker", "date", "score", "rsi", "pct_b", "z_score", "hit_bottom", *[f"ret_{k}w" for k in weeks], "next_move", "next_kind")


def longest_run(flags: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """Rows of the longest unbroken run in which the flag holds."""
    w = Window.partitionBy(by).orderBy(order)
    x = flags.select(by, order, flag.alias("flag_"), F.row_number().over(w).alias("n_")).where("flag_")
    runs = x.withColumn("run_", F.col("n_") - F.row_number().over(w)).groupBy(by, "run_").count()
    return runs.groupBy(by).agg(F.max("count").alias("longest"))
