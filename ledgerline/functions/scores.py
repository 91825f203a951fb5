"""Scores, tiers, labels and levels as Spark columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def banded(x: Column, table: Sequence[tuple[float, float]], op: str, beyond: float, missing: float | None = None) -> Column:
    """The score of the first band that holds ``x``; ``op`` is <=, < or >=."""
    holds = {"<=": lambda t: x <= t, "<": lambda t: x < t, ">=": lambda t: x >= t}[op]
    out = F.when(x.isNull() | F.isnan(x.cast("double")), F.lit(missing).cast("double"))
    for t, s in table:
        out = out.when(holds(t), float(s))
    return out.otherwise(float(beyond))


def score_rsi(x: Column) -> Column:
    return banded(x, V.RSI_SCORES, "<=", 0, 0)


def score_bollinger(x: Column) -> Column:
    return banded(x, V.BOLLINGER_SCORES, "<", 1, 5)


def score_mean_reversion(x: Column) -> Column:
    return banded(x, V.ZSCORE_SCORES, "<", 1, 5)


def score_stoch_rsi(x: Column) -> Column:
    return banded(x, V.STOCHASTIC_SCORES, "<=", 0.5, 5)


def score_williams(x: Column) -> Column:
    return banded(x, V.WILLIAMS_SCORES, "<=", 0.5, 5)


def score_pcr(volume: Column, open_interest: Column | None = None) -> Column:
    """Null without a volume ratio; a strong one is moved by half a point by the open interest."""
    base = banded(volume, V.PCR_SCORES, ">=", 1)
    if open_interest is None:
        return base
    strong = base >= 7
    return F.round(F.when(strong & (open_interest >= 1.5), F.least(base + 0.5, F.lit(10.0))).when(strong & (open_interest < 0.5), F.greatest(base - 0.5, F.lit(0.0))).otherwise(base), 1)


def reliable_options(options):
    """Rows of an options snapshot that may be scored: a ticker, no error, enough volume; one row for each ticker."""
    calls, puts = (F.coalesce(F.col(c), F.lit(0)) for c in ("call_volume", "put_volume"))
    failed = F.coalesce(F.col("error"), F.lit("")) != "" if "error" in options.columns else F.lit(False)
    return options.where(F.col("ticker").isNotNull() & ~failed & (calls >= V.PCR_MIN_CALLS) & (calls + puts >= V.PCR_MIN_TOTAL)).dropDuplicates(["ticker"])


def atr_regime(percentile: Column) -> Column:
    return F.when(percentile < 25, "compression").when(percentile > 75, "expansion").when(percentile.isNotNull(), "normal")


def atr_label(regime: Column) -> Column:
    return F.when(regime == "compression", "Compression").when(regime == "expansion", "Expansion").otherwise("Normal")


def cap_tier(cap: Column, tiers=V.CAP_TIERS) -> Column:
    """Half-open tiers; a missing or negative capitalisation is Unknown."""
    out = F.when(cap.isNull(), "Unknown")
    for name, lo, hi in tiers:
        out = out.when((cap >= lo) & (F.lit(True) if hi is None else cap < hi), name)
    return out.otherwise("Unknown")


def in_tiers(cap: Column, chosen: Sequence[str], tiers=V.CAP_TIERS) -> Column:
    """Whether the capitalisation is in any of the chosen tiers; no choice passes everything."""
    return cap_tier(cap, tiers).isin(*chosen) if chosen else F.lit(True)


def no_pcr_weights(weights: Mapping[str, float] = V.WEIGHTS) -> dict[str, float]:
    """The other weights over their sum; alike if that is not positive."""
    own = {k: w for k, w in weights.items() if k != "s_pcr"}
    total = sum(own.values())
    return {k: w / total for k, w in own.items()} if total > 0 else dict.fromkeys(own, 1 / len(own))


def weighted(weights: Mapping[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + F.col(name) * F.lit(float(w))
    return out


def composite(weights: Mapping[str, float] = V.WEIGHTS, pcr: Column | None = None, digits: int | None = 2) -> Column:
    """With the options score where there is one, else by the others' weights; rounded before any threshold unless ``digits`` is None."""
    plain = weighted(no_pcr_weights(weights))
    out = plain if pcr is None else F.when(pcr.isNotNull(), weighted(weights)).otherwise(plain)
    return out if digits is None else F.round(out, digits)


def weights_used(weights: Mapping[str, float] = V.WEIGHTS, pcr: Column | None = None) -> Column:
    """How the composite was weighted, as text."""
    names = {"s_rsi": "RSI", "s_bb": "BB", "s_mr": "MR", "s_pcr": "PCR", "s_stochrsi": "StochRSI", "s_williams": "Williams"}
    plain = " ".join(f"{names[k]}={w:.3f}" for k, w in no_pcr_weights(weights).items()) + " (no PCR)"
    full = " ".join(f"{names[k]}={weights[k]}" for k in names if k in weights)
    return F.lit(plain) if pcr is None else F.when(pcr.isNotNull(), full).otherwise(plain)


def adjust_weight(weights: Mapping[str, float], key: str, value: float) -> dict[str, float]:
    """One weight set, the others scaled so that all sum to 1; four digits. Raises for an unknown key or others that sum to 0."""
    if key not in V.WEIGHTS:
        raise ValueError(f"{key!r} is not a weight")
    others = {k: w for k, w in weights.items() if k != key and k in V.WEIGHTS}
    total = sum(others.values())
    if total == 0:
        raise ValueError("the other weights sum to 0")
    return {**weights, **{k: round(w * (1 - value) / total, 4) for k, w in others.items()}, key: value}


def setup_label(score: Column) -> Column:
    out = F.when(score >= V.SETUPS[0][0], V.SETUPS[0][1])
    for least, name in V.SETUPS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Monitor")


def levels(price: Column, atr: Column) -> dict[str, Column]:
    """Stop, targets and the entry zone, and the reward for the risk of the rounded stop and target."""
    out = {name: F.round(price + F.lit(k) * atr, 2) for name, k in V.LEVELS.items()}
    risk = price - out["stop_loss"]
    return out | {"rr_ratio": F.when(risk > 0, F.round((out["target_2"] - price) / risk, 2))}


def volume_ratio(volume: Column, average: Column) -> Column:
    return F.when(average > 0, volume / average).otherwise(1.0)


def score_bucket(score: Column) -> Column:
    """Buckets closed at the right; none for a score of 0 or less or above 10."""
    out = F.lit(None).cast("string")
    for lo, hi in V.SCORE_BUCKETS:
        out = F.when((score > lo) & (score <= hi), f"{lo:g}-{hi:g}").otherwise(out)
    return out


def z_bucket(z: Column, edges: Sequence[float] = V.Z_BUCKETS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in zip(edges, edges[1:]):
        out = F.when((z > lo) & (z <= hi), f"({lo:g}, {hi:g}]").otherwise(out)
    return out


def dispersion_bucket(signal: Column) -> Column:
    return F.when(signal == "bull", "broad").when(signal == "neutral", "neutral").when(signal == "bear", "narrow").otherwise("n/a")


def two_bucket(signal: Column) -> Column:
    return F.when(signal == "bull", "broad").when(signal.isin("neutral", "bear"), "not_broad").otherwise("unknown")


def period_key(date: Column, by: str) -> Column:
    """month 1997-03, quarter 1997Q1, year 1997, week (ISO) 1997-W09, date 1997-03-01."""
    if by == "week":
        return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), date), F.weekofyear(date))
    return {"month": F.date_format(date, "yyyy-MM"), "quarter": F.concat(F.year(date).cast("string"), F.lit("Q"), F.quarter(date).cast("string")), "year": F.year(date).cast("string"), "date": F.date_format(date, "yyyy-MM-dd")}[by]


def formatted(x: Column, digits: int = 2, default: str = "N/A") -> Column:
    """Fixed digits; null gives the default, infinity ``inf``."""
    return F.when(x.isNull() | F.isnan(x), default).when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(F.format_string(f"%.{digits}f", x))


def params_hash(*names: str) -> Column:
    """First ten hex digits of the hash of the columns as JSON, keys in order."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(names))), 256), 1, 10)
