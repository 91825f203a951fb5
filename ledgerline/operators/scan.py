"""The live scan: indicators of the last bar, gates in order, scores, levels, a ranking under a sector cap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import values as V
from .indicators import PARAMS, indicators, lookback, subscores
from .timeline import asof

REASONS = ("no_data", "volume", "market_cap", "rsi", "earnings", "low_score")


def least_history(params: Mapping[str, float] = PARAMS) -> int:
    """Bars that the live scan needs."""
    return max(params["bb_period"], params["mr_period"] // 4, params["rsi_period"]) + 5


def warm_up(params: Mapping[str, float] = PARAMS) -> int:
    """Bars that point-in-time scores need."""
    return max(params["mr_period"], params["bb_period"], params["rsi_period"], params["volume_period"]) + 5


def near_earnings(tickers: DataFrame, earnings: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """The tickers with an earnings date within ``days`` of ``as_of``; one without any date is not near."""
    soon = earnings.where(F.abs(F.datediff(F.col("earnings_date"), as_of)) <= days).select("ticker").distinct()
    return tickers.join(soon, "ticker", "left_semi")


def scan(
    bars: DataFrame, caps: DataFrame | None = None, options: DataFrame | None = None, earnings: DataFrame | None = None, as_of: str | None = None, weights: Mapping[str, float] = V.WEIGHTS,
    tiers: Sequence[str] = (), rsi_max: float = 50.0, min_avg_volume: float = 500_000.0, min_score: float = 0.0, **params,
) -> DataFrame:
    """A row for each ticker: the last bar's values, sub-scores, composite, levels, and ``reason``: the first gate that rejects it, or ok.

    caps(ticker, sector, market_cap), options and earnings(ticker, earnings_date) may be left out. ``tiers`` keeps only these
    capitalisations; without any, unknown ones pass.
    """
    p = PARAMS | params
    seen = bars.select("ticker").distinct()
    x = _last_bars(bars, p)
    if "sector" in x.columns:
        x = x.drop("sector")
    x = seen.join(x, "ticker", "left")
    if caps is None:
        x = x.withColumns({"sector": F.lit("Unknown"), "market_cap": F.lit(None).cast("double")})
    else:
        x = x.join(caps.select("ticker", "sector", "market_cap").dropDuplicates(["ticker"]), "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    if options is None:
        x = x.withColumns({"pcr_volume": F.lit(None).cast("double"), "s_pcr": F.lit(None).cast("double")})
    else:
        own = S.reliable_options(options)
        x = x.join(own.select("ticker", F.col("pcr_volume").cast("double").alias("pcr_volume"), S.score_pcr(F.col("pcr_volume"), F.col("pcr_oi")).alias("s_pcr")), "ticker", "left")
    if earnings is not None:
        day = F.lit(as_of).cast("date") if as_of else F.current_date()
        x = x.join(near_earnings(seen, earnings, day).withColumn("near_", F.lit(True)), "ticker", "left")
    near = F.coalesce(F.col("near_"), F.lit(False)) if earnings is not None else F.lit(False)
    pcr = F.col("s_pcr")
    x = x.withColumns({"composite": S.composite(weights, pcr), "weights_used": S.weights_used(weights, pcr), "cap_tier": S.cap_tier(F.col("market_cap"))})
    reason = (
        F.when(F.col("close").isNull() | (F.col("n_bars") < least_history(p)) | (F.col("close") <= 0), "no_data").when(F.col("avg_volume").isNull() | (F.col("avg_volume") < min_avg_volume), "volume")
        .when(~F.coalesce(S.in_tiers(F.col("market_cap"), tiers), F.lit(False)), "market_cap").when(F.col("rsi") > rsi_max, "rsi").when(near, "earnings").when(F.col("composite") < min_score, "low_score").otherwise("ok")
    )
    x = x.withColumns({"reason": reason, "setup": S.setup_label(F.col("composite"))} | S.levels(F.col("close"), F.col("atr")))
    return x.drop("near_")


def _last_bars(bars: DataFrame, p: Mapping[str, float]) -> DataFrame:
    """The last bar of each ticker with its indicators, sub-scores, ATR percentile and ``n_bars``, from as many bars as these depend on."""
    n_bars = bars.where("close is not null").groupBy("ticker").agg(F.count("*").alias("n_bars"))
    reach = max(p["atr_lookback"] + int(400 * max(1, p["rsi_period"] / 14, p["atr_period"] / 14)), p["mr_period"])  # what is older counts less than 1e-12 in a mean
    x = indicators(lookback(bars.where("close is not null"), reach), False, **p)
    back, all_ = Window.partitionBy("ticker").orderBy(F.desc("date")), Window.partitionBy("ticker")
    x = x.withColumns({"back_": F.row_number().over(back), "now_": F.first("atr").over(back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    near = F.col("back_") <= p["atr_lookback"]
    share = F.count(F.when(near & (F.col("atr") <= F.col("now_")), 1)).over(all_) / F.count(F.when(near, F.col("atr"))).over(all_) * 100
    x = x.withColumn("atr_percentile", F.when(F.col("atr").isNotNull(), share)).where("back_ = 1").drop("back_", "now_")
    return subscores(x.withColumn("atr_regime", S.atr_regime(F.col("atr_percentile")))).join(n_bars, "ticker")


def filter_summary(scanned: DataFrame) -> DataFrame:
    """How many tickers each gate rejects, in its order, and how many pass."""
    return scanned.groupBy("reason").agg(F.count("*").alias("n"))


def ranked(scanned: DataFrame, top_n: int = 20, max_per_sector: int = 3) -> DataFrame:
    """The best that pass, at most so many of a sector; equal scores go by ticker.

    The cap depends on the order within a sector alone, so only the sectors' first rows meet in the final order.
    """
    order = [F.desc("composite"), "ticker"]
    own = scanned.where("reason = 'ok'").withColumn("in_sector_", F.row_number().over(Window.partitionBy("sector").orderBy(*order))).where(f"in_sector_ <= {max_per_sector}").drop("in_sector_")
    best = own.orderBy(*order).limit(top_n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def watchlist(bars: DataFrame, tickers: Sequence[str], **how) -> DataFrame:
    """These tickers by the same scores with every gate but the history open."""
    own = bars.where(F.col("ticker").isin(*tickers))
    return scan(own, min_score=-999.0, rsi_max=999.0, min_avg_volume=0.0, **how).where("reason = 'ok'")


def excluded(bars: DataFrame, tickers: DataFrame, scored: DataFrame, params: Mapping[str, float] = PARAMS) -> DataFrame:
    """Why wanted tickers are missing from ``scored``."""
    need = least_history(params)
    state = bars.where("close is not null").groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("price"))
    x = tickers.select("ticker").distinct().join(scored.select("ticker"), "ticker", "left_anti").join(state, "ticker", "left")
    why = F.when(F.col("n").isNull(), "no data").when(F.col("n") < need, F.format_string("insufficient history (%d, need %d)", F.col("n"), F.lit(need))).when(F.col("price") <= 0, "invalid price").otherwise("unknown")
    return x.select("ticker", why.alias("reason"))


def display(scored: DataFrame) -> DataFrame:
    """The columns of a report under their short names; those that are missing are left out."""
    names = {
        "rank": "Rank", "ticker": "Ticker", "sector": "Sector", "cap_tier": "Cap", "composite": "Score", "setup": "Setup", "rsi": "RSI", "s_rsi": "s_RSI", "pct_b": "pct_B", "s_bb": "s_BB", "z_score": "Z_Score", "s_mr": "s_MR",
        "pcr_volume": "PCR", "s_pcr": "s_PCR", "stoch_k": "StochRSI_K", "s_stochrsi": "s_StochRSI", "williams_r": "Williams_R", "s_williams": "s_Williams", "atr_percentile": "ATR_Pct", "vol_ratio": "Vol_Ratio",
        "close": "Price", "atr": "ATR", "stop_loss": "Stop", "target_2": "T2", "rr_ratio": "RR",
    }
    digits = {"rsi": 1, "pct_b": 3, "z_score": 2, "stoch_k": 3, "williams_r": 1, "atr_percentile": 1, "vol_ratio": 2, "close": 2, "atr": 2, "pcr_volume": 2}
    return scored.select(*[(F.round(c, digits[c]) if c in digits else F.col(c)).alias(n) for c, n in names.items() if c in scored.columns])


def score_history(bars: DataFrame, weights: Mapping[str, float] = V.WEIGHTS, rsi_max: float = 50.0, min_avg_volume: float = 500_000.0, **params) -> DataFrame:
    """price, rsi, pct_b, z_score, the composite (not rounded) where every gate is open, and why it is not."""
    need = warm_up(PARAMS | params)
    x = subscores(indicators(bars, **params))
    open_ = (F.col("i") >= need) & (F.col("close") > 0) & (F.col("avg_volume") >= min_avg_volume) & (F.col("rsi") <= rsi_max) & (F.col("atr") > 0)
    reason = F.when(F.col("i") < need, "warmup").when(F.col("rsi") > rsi_max, "rsi_too_high").when(F.coalesce(open_, F.lit(False)), "ok").otherwise("other")
    return x.withColumn("reason", reason).select("ticker", "date", F.col("close").alias("price"), "rsi", "pct_b", "z_score", F.when(F.col("reason") == "ok", S.composite(weights, digits=None)).alias("score"), "reason")


def point_in_time(bars: DataFrame, weights: Mapping[str, float] = V.WEIGHTS, rsi_max: float = 50.0, min_avg_volume: float = 500_000.0, complete: bool = False, **params) -> DataFrame:
    """Every bar at which a ticker can be scored: price, atr, avg_volume, sub-scores, signal_score (rounded). Windows look back only, so a
    slice by date is never needed. ``complete`` also asks for every indicator, as the panel does."""
    x = subscores(indicators(bars, **params)).where((F.col("i") >= warm_up(PARAMS | params) - 1) & (F.col("close") > 0) & (F.col("avg_volume") >= min_avg_volume) & (F.col("rsi") <= rsi_max) & (F.col("atr") > 0))
    if complete:
        x = x.na.drop(subset=["rsi", "pct_b", "stoch_k", "williams_r"])
    return x.withColumn("signal_score", S.composite(weights))


def inspect(trades: DataFrame, bars: DataFrame, on: str = "entry_date", **params) -> DataFrame:
    """Trades with the indicators, sub-scores and composite of their ticker's last bar at or before the day, by the live scan's history; null with less."""
    p = PARAMS | params
    own = subscores(indicators(bars, True, **params)).where(F.col("i") >= least_history(p) - 1).withColumn("composite", S.composite())
    features = ["rsi", "pct_b", "z_score", "stoch_k", "stoch_d", "williams_r", "atr", "atr_percentile", "atr_regime", "vol_ratio", "composite"]
    return asof(trades, own.select("ticker", F.col("date").alias(on), *features), ["ticker"], on, features)


def alerts(scanned: DataFrame, threshold: float = 6.5) -> DataFrame:
    """What reaches the threshold, best first, without a sector cap."""
    return scanned.where((F.col("reason") == "ok") & (F.col("composite") >= threshold)).orderBy(F.desc("composite"), "ticker")


def digest(alerted: DataFrame, watched: DataFrame, missing: DataFrame) -> DataFrame:
    """The rows of the alert report: section, ticker, line."""
    line = F.concat_ws("  ", F.concat(F.lit("Score: "), S.formatted(F.col("composite"), 1)), "setup", F.concat(F.lit("RSI="), S.formatted(F.col("rsi"), 0)), F.concat(F.lit("BB%="), S.formatted(F.col("pct_b"))), F.concat(F.lit("Z="), S.formatted(F.col("z_score"))), F.concat(F.lit("R/R: "), S.formatted(F.col("rr_ratio"), 1)))
    part = lambda x, name: x.select(F.lit(name).alias("section"), "ticker", line.alias("line"))
    return part(alerted, "alerts").unionByName(part(watched, "watchlist")).unionByName(missing.select(F.lit("missing").alias("section"), "ticker", F.col("reason").alias("line")))
