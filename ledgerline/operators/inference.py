"""Tests of trade returns and of equity curves: clustered, bootstrapped, robust to autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.scores import period_key
from . import order
from .keep import kept
from .timeline import asof

PARTS = 48  # tasks that the draws of a bootstrap are dealt to, at most


def _own(trades: DataFrame, value: str) -> DataFrame:
    """Trades with a value and a date of entry."""
    return trades.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col("entry_date").isNotNull())


def clusters(trades: DataFrame, by: str = "month", value: str = "pnl_pct") -> DataFrame:
    """cluster, n, total: one row for each month (quarter, year, date) of entry."""
    own = _own(trades, value)
    return own.groupBy(period_key(F.col("entry_date"), by).alias("cluster")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))


def cluster_test(trades: DataFrame, by: str = "month", value: str = "pnl_pct", digits: int | None = 6) -> DataFrame:
    """One row: n, n_clusters, mean, sd, se_naive, t_naive, se_cluster, t_cluster, design_effect, n_eff; rounded unless ``digits`` is None."""
    own = _own(trades, value)
    whole = own.agg(F.count("*").alias("all_n"), F.avg(value).alias("mu"), F.stddev_samp(value).alias("sd"))
    u = F.col("total") - F.col("mu") * F.col("n")
    x = clusters(trades, by, value).crossJoin(F.broadcast(whole)).groupBy("all_n", "mu", "sd").agg(F.count("*").alias("g"), F.sum(u * u).alias("uu"))  # one row
    var = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1) * F.col("uu") / (F.col("all_n") * F.col("all_n")))
    x = x.withColumns({"se_cluster": F.sqrt(var), "se_naive": F.when(F.col("all_n") > 1, F.col("sd") / F.sqrt("all_n"))})
    effect = F.try_divide(F.pow("se_cluster", F.lit(2)), F.pow("se_naive", F.lit(2)))
    own_ = {"mean": F.col("mu"), "sd": F.col("sd"), "se_naive": F.col("se_naive"), "t_naive": F.try_divide("mu", "se_naive"), "se_cluster": F.col("se_cluster"), "t_cluster": F.try_divide("mu", "se_cluster"), "design_effect": effect, "n_eff": F.try_divide(F.col("all_n"), effect)}
    return x.select(F.col("all_n").alias("n"), F.col("g").alias("n_clusters"), *[(c if digits is None else F.round(c, digits)).alias(k) for k, c in own_.items()])


def without_best(trades: DataFrame, by: str = "month", value: str = "pnl_pct", ks: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """k, mean, t_cluster: the clustered test without the k best trades, a row for each k that leaves more than five. Of equal trades the earliest go first."""
    spark, best_first = trades.sparkSession, [F.desc("v_"), F.asc("entry_date")]  # equal trades of a day are of one cluster
    best = _own(trades, value).select(F.col(value).cast("double").alias("v_"), "entry_date", period_key(F.col("entry_date"), by).alias("cluster")).orderBy(*best_first).limit(max(ks))
    best = best.withColumn("place_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*best_first)))  # as many rows as the largest k
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k long"))
    gone = best.join(wanted, F.col("place_") <= F.col("k")).groupBy("k", "cluster").agg(F.count("*").alias("gone_"), F.sum("v_").alias("lost_"))
    x = clusters(trades, by, value).crossJoin(wanted).join(F.broadcast(gone), ["k", "cluster"], "left")
    n, total = F.col("n") - F.coalesce("gone_", F.lit(0)), F.col("total") - F.coalesce("lost_", F.lit(0.0))
    x = x.select("k", n.alias("n"), F.when(n > 0, total).otherwise(0.0).alias("total"))  # a row for each period of entry and k
    w = Window.partitionBy("k")
    x = x.withColumns({"all_n": F.sum("n").over(w), "mu": F.try_divide(F.sum("total").over(w), F.sum("n").over(w))}).where("all_n > 5 and n > 0")
    u = F.col("total") - F.col("mu") * F.col("n")
    x = x.groupBy("k", "all_n", "mu").agg(F.count("*").alias("g"), F.sum(u * u).alias("uu"))
    var = F.when(F.col("g") > 1, F.col("g") / (F.col("g") - 1) * F.col("uu") / (F.col("all_n") * F.col("all_n")))
    return x.select("k", F.col("mu").alias("mean"), F.try_divide("mu", F.sqrt(var)).alias("t_cluster"))


def drawn(seed: int, *what: Column) -> Column:
    """A number from 0 below 2^32 that seed and columns fix, in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *what)), 1, 8), 16, 10).cast("long")


def _draws(spark, draws: int, size: DataFrame) -> DataFrame:
    """draw, at (from 0): as many places for each draw as ``size`` (one row, n_) says."""
    cells = spark.range(0, draws, 1, max(1, min(PARTS, draws))).crossJoin(F.broadcast(size)).where("n_ > 0")  # one row
    return cells.select(F.col("id").alias("draw"), "n_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_") - 1)).alias("at"))


def cluster_bootstrap(trades: DataFrame, by: str = "month", value: str = "pnl_pct", draws: int = 10_000, seed: int = 42) -> DataFrame:
    """draw, mean: the pooled mean when whole clusters are drawn with replacement.

    Clusters are numbered in order (a row for each period of entry); each place of a draw hashes to a number, meets its cluster and is
    summed where it was made.
    """
    own = clusters(trades, by, value).withColumn("k_", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("cluster")) - 1)
    cells = _draws(trades.sparkSession, draws, own.agg(F.count("*").alias("n_")))
    cells = cells.select("draw", F.pmod(drawn(seed, F.col("draw"), F.col("at")), "n_").alias("k_"))
    return cells.join(own.select("k_", "n", "total"), "k_").groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))


def bootstrap_summary(draws: DataFrame, column: str = "mean") -> DataFrame:
    below, above = F.avg((F.col(column) <= 0).cast("double")), F.avg((F.col(column) >= 0).cast("double"))
    return draws.agg(F.percentile(column, 0.025).alias("ci_low"), F.percentile(column, 0.975).alias("ci_high"), below.alias("prob_le_0"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))


def shape(trades: DataFrame, value: str = "pnl_pct", rounded: bool = True) -> DataFrame:
    """n, median, win_rate, skew and excess kurtosis of the population."""
    to = F.round if rounded else lambda c, _: F.col(c) if isinstance(c, str) else c
    x = trades.agg(F.count(value).alias("n"), to(F.count_if(F.col(value) > 0) / F.count(value) * 100, 4).alias("win_rate"), to(F.skewness(value), 6).alias("skew"), to(F.kurtosis(value), 6).alias("excess_kurtosis"))
    return x.crossJoin(order.quantiles(trades, value, {"median": 0.5})).select("n", to("median", 4).alias("median"), "win_rate", "skew", "excess_kurtosis")  # one row each


def signed_ranks(trades: DataFrame, value: str = "pnl_pct") -> DataFrame:
    """n, rank_sum of the positive ones, ties: from the places of distinct sizes."""
    own = trades.where(F.col(value) != 0).select(F.abs(value).alias("a"), (F.col(value) > 0).cast("long").alias("p"))
    x = order.counted(own, "a", extra={"p": F.sum("p")}).withColumn("rank_", F.col("before_") + (F.col("c_") + 1) / 2)
    return x.agg(F.sum("c_").alias("n"), F.sum(F.col("rank_") * F.col("p")).alias("rank_sum"), F.sum(F.pow("c_", F.lit(3)) - F.col("c_")).alias("ties"))


def trade_significance(trades: DataFrame, by: str = "month", value: str = "pnl_pct", draws: int = 10_000, seed: int = 42, ks: Sequence[int] = (1, 3, 5, 10), share: float = 0.05) -> dict[str, float]:
    """The tests in one: statistics from the executors, p-values here. Raises for fewer than five trades.

    ``mean_excl_top{k}`` and ``t_cluster_excl_top{k}`` are those of ``without_best``, ``share_of_total_pnl_top{k}`` is what the k largest profits
    (``pnl``) have in all; None where no more than five trades are left.
    """
    paid = "pnl" in trades.columns
    trades = kept(_own(trades, value).select("entry_date", *dict.fromkeys([value, "pnl"] if paid else [value])), "trades")  # the tests read them some ten times
    core = cluster_test(trades, by, value, None).first()
    if core is None or core["n"] < 5:
        raise ValueError("five trades or more are needed")
    out = core.asDict() | {"p_naive": tails.t_two_sided(core["t_naive"], core["n"] - 1), "p_cluster": tails.t_two_sided(core["t_cluster"], core["n_clusters"] - 1)}
    w = signed_ranks(trades, value).first()
    out |= shape(trades, value, False).first().asDict() | {"trimmed_mean": order.trimmed_mean(trades, value, share).first()["trimmed"]}
    out |= bootstrap_summary(cluster_bootstrap(trades, by, value, draws, seed)).first().asDict() | {"p_wilcoxon": tails.wilcoxon(w["n"], w["rank_sum"], w["ties"]) if w["n"] else None}
    left = {r["k"]: r for r in without_best(trades, by, value, ks).collect()}
    total = trades.agg(F.sum("pnl")).first()[0] if paid else None
    gains = [r[0] for r in trades.select("pnl").orderBy(F.desc_nulls_last("pnl")).limit(max(ks)).collect()] if total else []
    for k in ks:
        r = left.get(k)
        out |= {f"mean_excl_top{k}": r and r["mean"], f"t_cluster_excl_top{k}": r and r["t_cluster"], f"share_of_total_pnl_top{k}": sum(x or 0 for x in gains[:k]) / total if r and total else None}
    return out


def paired_returns(equity: DataFrame, benchmark: DataFrame, periods: int = 12, rf: float = 0.0) -> DataFrame:
    """t, y, x: excess returns of the curve (date, portfolio_value) and of the benchmark (date, close) as of the same dates."""
    b = benchmark.where("close is not null").select("date", F.col("close").alias("b_"))
    z = asof(equity.select("date", F.col("portfolio_value").cast("double").alias("v_")), b, [], "date", ["b_"])
    w = Window.partitionBy(F.lit(0)).orderBy("date")  # a row for each period
    z = z.select("date", (F.col("v_") / F.lag("v_").over(w) - 1 - rf / periods).alias("y"), (F.col("b_") / F.lag("b_").over(w) - 1 - rf / periods).alias("x")).where("y is not null and x is not null")
    return z.withColumn("t", F.row_number().over(w))


def ols_hac(pairs: DataFrame, lags: int | None = None) -> DataFrame:
    """pairs(t, y, x) -> n, lags, alpha, beta, r2, se_alpha, se_beta, resid_sd: Bartlett weights, n / (n - 2)."""
    b = pairs.agg(F.count("*").cast("double").alias("n"), F.regr_slope("y", "x").alias("beta"), F.regr_intercept("y", "x").alias("alpha"), F.regr_r2("y", "x").alias("r2"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    b = b.withColumn("lags", F.lit(lags) if lags is not None else F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))
    own = pairs.crossJoin(F.broadcast(b.select("alpha", "beta", "lags"))).select("t", "lags", (F.col("y") - F.col("alpha") - F.col("beta") * F.col("x")).alias("u"), "x")  # one row
    own = own.withColumn("v", F.col("u") * F.col("x"))
    later = own.withColumn("t0", F.explode(F.sequence(F.greatest(F.col("t") - F.col("lags"), F.lit(1)), F.col("t"))))
    g = later.alias("p").join(own.select(F.col("t").alias("t0"), F.col("u").alias("u0"), F.col("v").alias("v0")), "t0")
    w = F.when(F.col("t") == F.col("t0"), 0.5).otherwise(1 - (F.col("t") - F.col("t0")) / (F.col("lags") + 1))
    s = g.agg(F.sum(2 * w * F.col("u") * F.col("u0")).alias("s00"), F.sum(w * (F.col("u") * F.col("v0") + F.col("v") * F.col("u0"))).alias("s01"), F.sum(2 * w * F.col("v") * F.col("v0")).alias("s11"), F.sum(F.when(F.col("t") == F.col("t0"), F.col("u") * F.col("u"))).alias("sse"))
    z = b.crossJoin(s).withColumn("det", F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))  # one row each
    c = F.col
    var_a = (c("sxx") * c("sxx") * c("s00") - 2 * c("sxx") * c("sx") * c("s01") + c("sx") * c("sx") * c("s11")) / (c("det") * c("det")) * c("n") / (c("n") - 2)
    var_b = (c("sx") * c("sx") * c("s00") - 2 * c("sx") * c("n") * c("s01") + c("n") * c("n") * c("s11")) / (c("det") * c("det")) * c("n") / (c("n") - 2)
    return z.select(c("n").cast("long").alias("n"), c("lags").cast("long").alias("lags"), "alpha", "beta", "r2", F.sqrt(var_a).alias("se_alpha"), F.sqrt(var_b).alias("se_beta"), F.sqrt(c("sse") / (c("n") - 2)).alias("resid_sd"))


def stationary_draws(pairs: DataFrame, draws: int, block: int, n: DataFrame, seed: int) -> DataFrame:
    """draw, t: the periods of stationary bootstraps: runs that start anew with a chance of 1 / block and wrap around."""
    cells = _draws(pairs.sparkSession, draws, n)
    fresh = (F.col("at") == 0) | (drawn(seed, F.lit("start"), F.col("draw"), F.col("at")) < (1 << 32) // max(block, 1))
    cells = cells.withColumn("from_", F.when(fresh, F.struct("at", F.pmod(drawn(seed, F.lit("place"), F.col("draw"), F.col("at")), "n_").alias("k"))))
    last = F.last("from_", ignorenulls=True).over(Window.partitionBy("draw").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return cells.withColumn("from_", last).select("draw", (F.pmod(F.col("from_.k") + F.col("at") - F.col("from_.at"), "n_") + 1).alias("t"))


def alpha_bootstrap(pairs: DataFrame, draws: int = 5000, block: int | None = None, periods: int = 12, seed: int = 42) -> DataFrame:
    """draw, alpha_annual (percent), sharpe of paired stationary bootstraps; blocks of about the cube root of the number of periods."""
    n = pairs.agg(F.count("*").alias("n_"))
    size = block or max(2, round(n.first()[0] ** (1 / 3)))
    x = stationary_draws(pairs, draws, size, n, seed).join(pairs.select(F.col("t").cast("long").alias("t"), "y", "x"), "t")
    g = x.groupBy("draw").agg(F.regr_intercept("y", "x").alias("a"), (F.avg("y") / F.stddev_samp("y") * math.sqrt(periods)).alias("sharpe"))
    return g.select("draw", ((F.pow(1 + F.col("a"), F.lit(periods)) - 1) * 100).alias("alpha_annual"), "sharpe")


def alpha_test(equity: DataFrame, benchmark: DataFrame, periods: int = 12, rf: float = 0.0, lags: int | None = None, draws: int = 5000, seed: int = 42) -> dict[str, float]:
    """Alpha against a benchmark with robust errors, Sharpe with the error for skew and fat tails, bootstraps. Raises for fewer than 24 periods."""
    pairs = paired_returns(equity, benchmark, periods, rf)
    if pairs.count() < 24:
        raise ValueError("24 periods or more are needed")
    o = ols_hac(pairs, lags).first().asDict()
    d = F.col("y") - F.col("x")
    m = pairs.agg(F.avg("y").alias("mu"), F.stddev_samp("y").alias("sd"), F.skewness("y").alias("g3"), (F.kurtosis("y") + 3).alias("g4"), F.avg(d).alias("active"), F.stddev_samp(d).alias("te")).first()
    lag1 = pairs.withColumn("before_", F.lag("y").over(Window.partitionBy(F.lit(0)).orderBy("t"))).agg(F.corr("y", "before_")).first()[0]
    root, sr = math.sqrt(periods), m["mu"] / m["sd"]
    se = math.sqrt(max((1 - m["g3"] * sr + (m["g4"] - 1) / 4 * sr * sr) / (o["n"] - 1), 0)) * root
    boot = alpha_bootstrap(pairs, draws, None, periods, seed)
    a, s = (bootstrap_summary(boot, c).first() for c in ("alpha_annual", "sharpe"))
    t = o["alpha"] / o["se_alpha"]
    return o | {
        "alpha_annual_pct": ((1 + o["alpha"]) ** periods - 1) * 100, "t_alpha": t, "p_alpha": tails.t_two_sided(t, o["n"] - 2), "alpha_ci": (a["ci_low"], a["ci_high"]), "prob_alpha_le_0": a["prob_le_0"],
        "tracking_error_pct": m["te"] * root * 100, "information_ratio": m["active"] * periods / (m["te"] * root) if m["te"] else None, "sharpe": sr * root, "sharpe_se": se, "p_sharpe": tails.normal_tail(sr * root / se) if se > 0 else None,
        "sharpe_boot_ci": (s["ci_low"], s["ci_high"]), "skew": m["g3"], "kurtosis": m["g4"], "lag1": lag1,
    }


def sample_size(mean: float, sd: float, n: int, n_eff: float, years: float, size: float = 0.05, power: float = 0.8) -> dict[str, float]:
    """How many independent trades show the measured edge, and whether there are as many."""
    k = tails.normal_quantile(1 - size / 2) + tails.normal_quantile(power)
    need = (k * sd / mean) ** 2 if mean > 0 else math.inf
    a_year = n_eff / years
    return {"n_raw": n, "n_eff": n_eff, "required_n_eff": need, "adequacy_ratio": n_eff / need if 0 < need < math.inf else 0.0, "mde_mean_pct": k * sd / math.sqrt(n_eff), "effective_trades_per_year": a_year, "years_needed": need / a_year if a_year > 0 else math.inf}


def window_independence(start: str, end: str, years: float = 2, step_months: int = 6) -> dict[str, float]:
    """How many rolling windows there are, and how many of them do not overlap."""
    a, b = pd.Timestamp(start), pd.Timestamp(end)
    total, n = (b - a).days / 365.25, 0
    while a + pd.DateOffset(months=step_months * n) + pd.DateOffset(years=int(years)) <= b:
        n += 1
    return {"n_windows": n, "total_years": total, "n_independent": int(total // years), "overlap_pct": (1 - step_months / (years * 12)) * 100, "windows_per_event": years * 12 / step_months}


def placebo_verdict(baseline: dict[str, float], arm: dict[str, float], placebos: DataFrame, metrics=("annual_return", "sharpe_ratio", "max_drawdown")) -> DataFrame:
    """Where the arm's difference stands among those of the placebos: percentile, z, p5 and p95 of the null."""
    long = placebos.unpivot([], list(metrics), "metric", "value")
    base, real = (F.create_map(*[x for m in metrics for x in (F.lit(m), F.lit(float(d[m])))])[F.col("metric")] for d in (baseline, arm))
    x = long.select("metric", (F.col("value") - base).alias("null_"), (real - base).alias("real_"))
    g = x.groupBy("metric").agg(F.first("real_").alias("real_delta"), F.avg("null_").alias("mean"), F.stddev_samp("null_").alias("sd"), F.percentile("null_", 0.05).alias("p5"), F.percentile("null_", 0.95).alias("p95"), (F.avg((F.col("null_") <= F.col("real_")).cast("double")) * 100).alias("percentile"))
    return g.withColumn("z", F.when(F.col("sd") > 0, (F.col("real_delta") - F.col("mean")) / F.col("sd")))
