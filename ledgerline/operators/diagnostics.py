"""Panels of scores and what can be told from them; sweeps; benchmarks; verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import values as V
from .keep import kept
from .metrics import average_ranks
from .scan import point_in_time
from .timeline import asof, review_dates, weekday_review_dates

SUBSCORES = ("s_rsi", "s_bb", "s_mr", "s_stochrsi", "s_williams")
# The ranges that weights are drawn from.
BOUNDS = {"s_rsi": (0.25, 0.35), "s_bb": (0.15, 0.25), "s_mr": (0.10, 0.20), "s_stochrsi": (0.05, 0.15), "s_williams": (0.05, 0.15)}


def score_panel(bars: DataFrame, weekday: int | None = 1, **how) -> DataFrame:
    """Snapshots at the review dates (a weekday, or the first day of each month): each ticker's last bar on or before, if its gates were open then."""
    days = bars.select("date").distinct()
    reviews = review_dates(days) if weekday is None else weekday_review_dates(days, weekday)
    state = bars.where("close is not null").select("ticker", "date", F.col("date").alias("bar_date"))
    spans = bars.groupBy("ticker").agg(F.min("date").alias("first_"))
    wanted = spans.crossJoin(F.broadcast(reviews)).where(F.col("review_date") >= F.col("first_")).select("ticker", F.col("review_date").alias("date"))  # tickers by review dates is the result's size
    at = asof(wanted, state, ["ticker"], "date", ["bar_date"])
    own = point_in_time(bars, complete=True, **how).select("ticker", F.col("date").alias("bar_date"), F.round("close", 2).alias("price"), F.round("rsi", 2).alias("rsi"), F.round("pct_b", 4).alias("pct_b"), F.round("z_score", 4).alias("z_score"), F.round("stoch_k", 4).alias("stoch_k"), F.round("williams_r", 2).alias("williams_r"), *SUBSCORES)
    return at.join(own, ["ticker", "bar_date"]).drop("bar_date")


def distribution(panel: DataFrame, weights: Mapping[str, float] = V.WEIGHTS, top: float = 8.5, bottom: float = 2.0) -> DataFrame:
    """Per date: n, mean, std, unbiased skew, shares at the ends, p10, p50, p90."""
    c = F.col("c")
    n = F.count("c")
    skew = F.when(n > 2, F.skewness("c") * F.sqrt(n * (n - 1.0)) / (n - 2))
    return panel.withColumn("c", S.composite(weights, digits=None)).groupBy("date").agg(
        n.alias("n"), F.round(F.avg("c"), 2).alias("mean"), F.round(F.stddev_samp("c"), 2).alias("std"), F.round(skew, 2).alias("skew"), F.round(F.count_if(c >= top) / n * 100, 1).alias("pct_top_bin"), F.round(F.count_if(c <= bottom) / n * 100, 1).alias("pct_bottom_bin"),
        *[F.round(F.percentile("c", q / 100), 2).alias(f"p{q}") for q in (10, 50, 90)],
    )


def saturation_verdict(distribution_: DataFrame) -> DataFrame:
    x = distribution_.agg(F.avg("pct_top_bin").alias("m"))
    return x.select(F.round("m", 4).alias("avg_pct_top_bin"), F.when(F.col("m") >= 15, "saturated").when(F.col("m") >= 8, "borderline").otherwise("ok").alias("verdict"))


def correlation_audit(panel: DataFrame, method: str = "pearson", threshold: float = 0.60, columns: Sequence[str] = SUBSCORES) -> DataFrame:
    """a, b, corr, flagged for each pair of sub-scores."""
    base = x = panel.select(*columns)
    names = {c: c for c in columns}
    if method == "spearman":
        base = x = kept(base, "panel")  # read for the ranks of each column
        for c in columns:
            x = average_ranks(x, c, f"r_{c}", of=base)
        names = {c: f"r_{c}" for c in columns}
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    row = x.agg(*[F.corr(names[a], names[b]).alias(f"{a}|{b}") for a, b in pairs])
    long = row.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), F.round("corr", 4).alias("corr"), (F.abs("corr") >= threshold).alias("flagged"))


def momentum_overlap(audit: DataFrame) -> DataFrame:
    """Whether two or more pairs of the three oversold scores are flagged."""
    trio = ("s_rsi", "s_stochrsi", "s_williams")
    return audit.agg((F.count_if(F.col("flagged") & F.col("a").isin(*trio) & F.col("b").isin(*trio)) >= 2).alias("overlap"))


def mean_ranks(x: np.ndarray) -> np.ndarray:
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def weight_sensitivity(panel: DataFrame, weights: Mapping[str, float] = V.WEIGHTS, bounds: Mapping[str, tuple[float, float]] = BOUNDS, draws: int = 200, top_n: int = 20, seed: int = 42) -> DataFrame:
    """date, draw, spearman, overlap, delta: rankings by drawn weights against the base ranking. A date's names are one group; dates with too few are left out."""
    r = np.random.default_rng(seed)
    own = S.no_pcr_weights(weights)
    base = np.array([own[c] for c in SUBSCORES])
    drawn = np.column_stack([r.uniform(*bounds[c], draws) for c in SUBSCORES])
    drawn /= drawn.sum(1, keepdims=True)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(g) >= max(5, top_n // 2):
            g = g.sort_values("ticker")
            x = g[list(SUBSCORES)].to_numpy(float)
            b = np.round(x @ base, 9)  # equal scores stay ties
            rank, top = mean_ranks(b), set(np.argsort(-b, kind="stable")[:top_n].tolist())
            for k, w in enumerate(drawn):
                c = np.round(x @ w, 9)
                own = mean_ranks(c)
                rho = float(np.corrcoef(rank, own)[0, 1]) if rank.std() > 0 and own.std() > 0 else None
                out.append((g["date"].iloc[0], k, rho, len(top & set(np.argsort(-c, kind="stable")[:top_n].tolist())) / max(1, len(top)), float(np.abs(c - b).mean())))
        return pd.DataFrame(out, columns=["date", "draw", "spearman", "overlap", "delta"])

    return panel.select("date", "ticker", *SUBSCORES).groupBy("date").applyInPandas(run, "date date, draw int, spearman double, overlap double, delta double")


def sensitivity_summary(drawn: DataFrame) -> DataFrame:
    x = drawn.agg(F.countDistinct("date").alias("n_dates"), F.avg("spearman").alias("spearman_mean"), F.percentile("spearman", 0.1).alias("spearman_p10"), F.avg("overlap").alias("overlap_mean"), F.percentile("overlap", 0.1).alias("overlap_p10"), F.avg("delta").alias("mean_abs_delta"))
    good = lambda s, o: (F.col("spearman_mean") >= s) & (F.col("overlap_mean") >= o)
    return x.withColumn("verdict", F.when(good(0.90, 0.85), "stable").when(good(0.75, 0.60), "medium").otherwise("fragile"))


def local_stability(sweep: DataFrame, x: str, y: str, metric: str, current_x: float, current_y: float) -> DataFrame:
    """The current cell of a grid against its best one and its up to eight neighbours, and a verdict; no row if the cell is not in the grid."""
    cells = sweep.groupBy(x, y).agg(F.avg(metric).alias("v"))
    place = lambda c, n: cells.select(c).distinct().withColumn(n, F.row_number().over(Window.orderBy(c)))  # noqa: E731  # a row for each value of an axis
    cells = cells.join(place(x, "xi"), x).join(place(y, "yi"), y)
    here = cells.where((F.col(x) == current_x) & (F.col(y) == current_y)).select(F.col("v").alias("current_value"), F.col("xi").alias("x0"), F.col("yi").alias("y0"))
    near = (F.abs(F.col("xi") - F.col("x0")) <= 1) & (F.abs(F.col("yi") - F.col("y0")) <= 1) & ~((F.col("xi") == F.col("x0")) & (F.col("yi") == F.col("y0")))
    g = cells.crossJoin(F.broadcast(here)).groupBy("current_value").agg(F.max("v").alias("grid_best_value"), F.count_if(near & F.col("v").isNotNull()).alias("n_neighbors"), F.avg(F.when(near, F.col("v"))).alias("neighbor_mean"), F.stddev_samp(F.when(near, F.col("v"))).alias("neighbor_std"))  # one row
    sd = F.col("neighbor_std")
    z = F.when(sd > 0, F.abs(F.col("current_value") - F.col("neighbor_mean")) / sd).otherwise(0.0)
    verdict = F.when(F.col("n_neighbors") == 0, "edge_of_grid").when((sd > F.abs("neighbor_mean") * 0.5) & (sd > 0), "fragile").when(z > 3, "spike_worth_checking").otherwise("stable")
    return g.select("current_value", "grid_best_value", (F.col("grid_best_value") - F.col("current_value")).alias("gap_to_best"), "n_neighbors", "neighbor_mean", "neighbor_std", verdict.alias("verdict"))


def equal_weight(bars: DataFrame, tickers: DataFrame, reviews: DataFrame, start: str, capital: float = 10_000.0) -> DataFrame:
    """date, portfolio_value: the capital split over the tickers that trade from ``start`` on, held, and marked at the last close on or before each review date (the entry price before the first)."""
    closes = bars.where("close is not null").join(tickers.select("ticker").distinct(), "ticker", "left_semi").select("ticker", "date", "close")
    entry = closes.where(F.col("date") >= F.lit(start).cast("date")).groupBy("ticker").agg(F.min_by("close", "date").alias("entry_"))
    held = entry.crossJoin(F.broadcast(reviews.select(F.col("review_date").alias("date"))))  # tickers by review dates is what is summed
    marked = asof(held, closes.select("ticker", "date", F.col("close").alias("mark_")), ["ticker"], "date", ["mark_"])
    n = entry.agg(F.count("*").alias("n_"))
    return marked.crossJoin(F.broadcast(n)).groupBy("date").agg(F.sum(capital / F.col("n_") / F.col("entry_") * F.coalesce("mark_", "entry_")).alias("portfolio_value"))  # one row


def exposure_attribution(strategy: Column, equal: Column, benchmark: Column) -> dict[str, Column]:
    """Picking and exposure gaps, and the share of the whole that exposure makes where both point one way."""
    exposure, whole = equal - benchmark, strategy - benchmark
    share = F.when(whole != 0, exposure / whole * 100)
    return {"picking_gap": strategy - equal, "exposure_gap": exposure, "pct_from_exposure": F.when(share.between(0, 100), share)}


def monte_carlo_summary(simulated: DataFrame, known_return: float | None = None, known_drawdown: float | None = None) -> DataFrame:
    """Percentile bands of total_return and max_drawdown, the chance of a loss, and where known values rank. The 5th percentile of drawdowns is the severe end."""
    r, d = F.col("total_return"), F.col("max_drawdown")
    own = {f"return_p{q}": F.percentile(r, q / 100) for q in (5, 25, 50, 75, 95)} | {f"drawdown_p{q}": F.percentile(d, q / 100) for q in (5, 50, 95)}
    own |= {"prob_negative_return": F.count_if(r < 0) / F.count("*") * 100}
    own |= {} if known_return is None else {"known_return_percentile": F.count_if(r < known_return) / F.count("*") * 100}
    own |= {} if known_drawdown is None else {"known_drawdown_percentile": F.count_if(d < known_drawdown) / F.count("*") * 100}
    return simulated.agg(F.count("*").alias("n_simulations"), *[F.round(c, 2).alias(k) for k, c in own.items()])


def luck_verdict(percentile: Column) -> Column:
    return F.when(percentile >= 90, "optimistic tail").when(percentile <= 10, "pessimistic tail").otherwise("unremarkable")


def histogram(df: DataFrame, column: str, bins: int = 25) -> DataFrame:
    """bin, low, high, n: equal widths from the least to the greatest value; what a plot needs."""
    ends = df.agg(F.min(column).cast("double").alias("lo_"), F.max(column).cast("double").alias("hi_"))
    x = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends))  # one row
    width = (F.col("hi_") - F.col("lo_")) / bins
    k = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo_")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    return x.groupBy(k.alias("bin"), "lo_", "hi_").agg(F.count("*").alias("n")).select("bin", F.round(F.col("lo_") + F.col("bin") * width, 6).alias("low"), F.round(F.col("lo_") + (F.col("bin") + 1) * width, 6).alias("high"), "n")
