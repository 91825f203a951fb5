"""Costs, profits and option values as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def commission(shares: Column, price: Column, per_share: float = 0.005, least: float = 1.0, most_share: float = 0.01) -> Column:
    """By the share, at least ``least``, at most a share of the value."""
    n = F.abs(shares)
    return F.least(F.greatest(n * per_share, F.lit(least)), n * price * most_share)


def entry_fill(price: Column, slippage: float = 0.0005) -> Column:
    return price * (1 + slippage)


def exit_fill(price: Column, slippage: float = 0.0005) -> Column:
    return price * (1 - slippage)


def pnl(entry: Column, exit_: Column, shares: Column) -> Column:
    """Without commissions, to the cent."""
    return F.round((exit_ - entry) * shares, 2)


def pnl_pct(entry: Column, exit_: Column) -> Column:
    return F.round((exit_ - entry) / entry * 100, 2)


def normal_cdf(x: Column) -> Column:
    """Polynomial on both sides of 0; error below 8e-8."""
    z = F.abs(x)
    k = 1 / (1 + F.lit(0.2316419) * z)
    # The coefficients of the approximation.
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def call_value(spot: Column, strike: Column, years: Column, rate: float = 0.04, sigma: float = 0.38) -> Column:
    """Black-Scholes call; what it is worth at once where there is no time, price, strike or volatility."""
    root = F.lit(sigma) * F.sqrt(years)
    d1 = (F.log(spot / strike) + (rate + sigma * sigma / 2) * years) / root
    value = spot * normal_cdf(d1) - strike * F.exp(-rate * years) * normal_cdf(d1 - root)
    intrinsic = F.greatest(spot - strike, F.lit(0.0))
    return intrinsic if sigma <= 0 else F.when((years <= 0) | (spot <= 0) | (strike <= 0), intrinsic).otherwise(value)
