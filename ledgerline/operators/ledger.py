"""The ledger of real positions: value, history, benchmark, suggestions.

Positions have ticker, entry_date, entry_price, shares, status (open or closed),
exit_date, exit_price, stop_loss, target. Prices have ticker, date, close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import formatted
from .timeline import asof, latest

INITIAL_CAPITAL = 10_000.0
HISTORY = ("date", "portfolio_value", "portfolio_return_pct", "spy_equivalent_value", "spy_return_pct", "alpha_pct", "n_open_positions")


def _cost() -> Column:
    return F.col("entry_price") * F.col("shares")


def _realized() -> Column:
    return (F.col("exit_price") - F.col("entry_price")) * F.col("shares")


def portfolio_value(positions: DataFrame, bars: DataFrame, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """One row: cash, open_value, total_value, n_open. Cash is the initial capital less the cost of open positions plus what closed ones made."""
    x = positions.join(latest(bars).select("ticker", "price"), "ticker", "left")
    is_open = F.col("status") != "closed"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    x = x.agg((initial - total(F.when(is_open, _cost())) + total(F.when(~is_open, _realized()))).alias("cash"), total(F.when(is_open, F.col("price") * F.col("shares"))).alias("open_value"), F.count_if(is_open).alias("n_open"))
    return x.select(F.round("cash", 2).alias("cash"), F.round("open_value", 2).alias("open_value"), F.round(F.col("cash") + F.col("open_value"), 2).alias("total_value"), "n_open")


def exit_suggestions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Open positions whose last price is at or below the stop, or at or above the target; for information."""
    x = positions.where("status <> 'closed'").join(latest(bars).select("ticker", "price"), "ticker")
    flag = F.when(F.col("price") <= F.col("stop_loss"), "below stop_loss").when(F.col("price") >= F.col("target"), "target reached")
    return x.withColumn("flag", flag).where("flag is not null").select("ticker", F.round("price", 2).alias("current_price"), "stop_loss", "target", "flag")


def benchmark_value(positions: DataFrame, benchmark: DataFrame, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """What the capital would be worth in the benchmark (date, close) since the first entry."""
    first = positions.agg(F.min("entry_date").alias("first_"))
    x = benchmark.where("close is not null").join(F.broadcast(first), F.col("date") >= F.col("first_"))  # one row
    return x.agg(F.round(F.coalesce(initial / F.min_by("close", "date") * F.max_by("close", "date"), F.lit(initial)), 2).alias("benchmark_value"))


def snapshot(positions: DataFrame, bars: DataFrame, benchmark: DataFrame, day: str, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """The day's row of the history."""
    x = portfolio_value(positions, bars, initial).crossJoin(benchmark_value(positions, benchmark, initial))  # one row each
    pct = lambda c: (F.col(c) - initial) / initial * 100
    return x.select(F.lit(day).alias("date"), F.col("total_value").alias("portfolio_value"), F.round(pct("total_value"), 2).alias("portfolio_return_pct"), F.col("benchmark_value").alias("spy_equivalent_value"), F.round(pct("benchmark_value"), 2).alias("spy_return_pct"), F.round(pct("total_value") - pct("benchmark_value"), 2).alias("alpha_pct"), F.col("n_open").alias("n_open_positions"))


def upsert(history: DataFrame, rows: DataFrame, key: str = "date") -> DataFrame:
    """``history`` with ``rows`` in place of those of the same key."""
    return history.join(rows.select(key).distinct(), key, "left_anti").select(*history.columns).unionByName(rows.select(*history.columns))


def backfill(positions: DataFrame, bars: DataFrame, benchmark: DataFrame, initial: float = INITIAL_CAPITAL) -> DataFrame:
    """The whole history over the benchmark's trading days, from the first entry on.

    Cash and what is open change on entries and exits only, so a running sum over the days gives them; values are sums over held
    (ticker, day) pairs at the last close on or before the day. A position without a price costs, but is worth nothing and not counted.
    """
    first = positions.agg(F.min("entry_date").cast("date").alias("first_"))
    days = benchmark.where("close is not null").join(F.broadcast(first), F.col("date") >= F.col("first_")).select("date", F.col("close").alias("bench_"))
    own = positions.select("ticker", F.col("entry_date").cast("date").alias("d0"), F.col("exit_date").cast("date").alias("d1"), "shares", _cost().alias("cost"), _realized().alias("gain"))
    moves = own.select(F.col("d0").alias("date"), (-F.col("cost")).alias("cash_")).unionByName(own.where("d1 is not null").select(F.greatest("d0", "d1").alias("date"), (F.col("cost") + F.col("gain")).alias("cash_"))).groupBy("date").agg(F.sum("cash_").alias("cash_"))
    flow = days.select("date", "bench_").unionByName(moves.select("date", F.lit(None).cast("double").alias("bench_"), "cash_"), allowMissingColumns=True)
    w = Window.orderBy("date").rangeBetween(Window.unboundedPreceding, 0)  # a row for each day
    cash = flow.withColumn("cash", initial + F.coalesce(F.sum("cash_").over(w), F.lit(0.0))).where("bench_ is not null").select("date", "bench_", "cash")
    calendar = days.select("date").withColumn("month_", F.trunc("date", "month"))
    far = days.agg(F.max("date")).first()[0]
    until = F.least(F.coalesce("d1", F.lit(far)), F.lit(far))
    held = own.where(F.col("d0") <= until).withColumn("month_", F.explode(F.sequence(F.trunc("d0", "month"), F.trunc(until, "month"), F.expr("interval 1 month")))).join(calendar, "month_")
    held = held.where((F.col("date") >= F.col("d0")) & (F.col("d1").isNull() | (F.col("date") < F.col("d1")))).groupBy("ticker", "date").agg(F.sum("shares").alias("shares"), F.count("*").alias("k"))
    marked = asof(held, bars.where("close is not null").select("ticker", "date", F.col("close").alias("mark_")), ["ticker"], "date", ["mark_"]).where("mark_ is not null")
    value = marked.groupBy("date").agg(F.sum(F.col("shares") * F.col("mark_")).alias("open_value"), F.sum("k").alias("n_open"))
    x = cash.join(value, "date", "left").withColumn("v", F.col("cash") + F.coalesce("open_value", F.lit(0.0)))
    b0 = days.agg(F.min_by("bench_", "date").alias("b0"))
    x = x.crossJoin(F.broadcast(b0)).withColumn("s", initial / F.col("b0") * F.col("bench_"))  # one row
    pct = lambda c: (F.col(c) - initial) / initial * 100
    return x.select(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("v", 2).alias("portfolio_value"), F.round(pct("v"), 2).alias("portfolio_return_pct"), F.round("s", 2).alias("spy_equivalent_value"), F.round(pct("s"), 2).alias("spy_return_pct"),
        F.round(pct("v") - pct("s"), 2).alias("alpha_pct"), F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open_positions"),
    )


def track(positions: DataFrame, bars: DataFrame, benchmark: DataFrame, today: str) -> DataFrame:
    """Each position's return beside that of the benchmark over the same days; positions without a price or a benchmark are left out.

    The benchmark's first close at or after the entry and its last at or before the end are as-of joins over distinct days.
    """
    closed = (F.col("status") == "closed") & F.col("exit_price").isNotNull()
    x = positions.join(latest(bars).select("ticker", F.col("price").alias("last_")), "ticker", "left")
    x = x.withColumns({"price_now": F.when(closed, F.col("exit_price")).otherwise(F.col("last_")), "end_": F.when(closed, F.col("exit_date")).otherwise(F.lit(today)).cast("date"), "entry_date": F.col("entry_date").cast("date")}).where("price_now is not null")
    b = benchmark.where("close is not null")
    x = asof(x, b.select(F.col("date").alias("entry_date"), F.struct("date", "close").alias("b0_")), [], "entry_date", ["b0_"], forward=True)
    x = asof(x, b.select(F.col("date").alias("end_"), F.struct("date", "close").alias("b1_")), [], "end_", ["b1_"]).where("b0_.date <= b1_.date")
    own, bench = (F.col("price_now") - F.col("entry_price")) / F.col("entry_price") * 100, (F.col("b1_.close") - F.col("b0_.close")) / F.col("b0_.close") * 100
    return x.select("ticker", "status", "entry_date", F.round("entry_price", 2).alias("entry_price"), F.round("price_now", 2).alias("price_now"), F.round(own, 2).alias("return_pct"), F.round(bench, 2).alias("benchmark_return_pct"), F.round(own - bench, 2).alias("alpha_pct"))


def track_summary(tracked: DataFrame) -> DataFrame:
    return tracked.agg(F.count("*").alias("n"), F.round(F.avg("alpha_pct"), 4).alias("avg_alpha_pct"), F.round(F.count_if(F.col("alpha_pct") > 0) / F.count("*") * 100, 4).alias("beat_rate_pct"))


POSITION = ("ticker", "entry_date", "entry_price", "shares", "composite_score", "setup", "sector", "rsi", "pct_b", "z_score", "stoch_k", "stoch_d", "williams_r", "atr_percentile", "atr_regime", "vol_ratio", "pcr_volume", "avg_volume_m", "stop_loss", "target", "status", "exit_date", "exit_price")


def position_row(scored: DataFrame, ticker: str, shares: float, entry_date: str) -> DataFrame:
    """The ledger row of a ticker that the scan scored; raises if it did not."""
    own = scored.where((F.col("ticker") == ticker) & (F.col("reason") == "ok"))
    if own.isEmpty():
        raise ValueError(f"{ticker} is not among the scored tickers")
    c = {"entry_date": F.lit(entry_date).cast("date"), "entry_price": F.round("close", 2), "shares": F.lit(float(shares)), "composite_score": F.col("composite"), "avg_volume_m": F.round(F.col("avg_volume") / 1e6, 1), "target": F.col("target_2"), "status": F.lit("open"), "exit_date": F.lit(None).cast("date"), "exit_price": F.lit(None).cast("double")}
    return own.select(*[c.get(name, F.col(name) if name not in c else None).alias(name) for name in POSITION])


def historical_position_row(history: DataFrame, ticker: str, shares: float, entry_date: str, paid: float) -> DataFrame:
    """The ledger row of a past entry: scores as of the entry day, without options; blank where the gates were not open then."""
    seen = history.where((F.col("ticker") == ticker) & (F.col("date") <= F.lit(entry_date).cast("date"))).groupBy("ticker").agg(F.max_by(F.struct("score", "rsi", "pct_b", "z_score", "reason"), "date").alias("x"))
    row = history.sparkSession.range(1).select(F.lit(ticker).alias("ticker"), F.lit(entry_date).cast("date").alias("entry_date"), F.lit(float(paid)).alias("entry_price"), F.lit(float(shares)).alias("shares")).join(seen, "ticker", "left")
    ok = F.col("x.reason") == "ok"
    own = {"composite_score": F.round("x.score", 2), "rsi": F.round("x.rsi", 1), "pct_b": F.round("x.pct_b", 3), "z_score": F.round("x.z_score", 2)}
    return row.select("ticker", "entry_date", "entry_price", "shares", *[F.when(ok, c).alias(k) for k, c in own.items()], F.lit("open").alias("status"))


def report(history: DataFrame) -> DataFrame:
    """Lines of the daily report."""
    c = lambda name: formatted(F.col(name))
    return history.select("date", F.concat_ws("  ", F.concat(F.lit("Portfolio: $"), c("portfolio_value")), F.concat(c("portfolio_return_pct"), F.lit("%")), F.concat(F.lit("Benchmark: $"), c("spy_equivalent_value")), F.concat(F.lit("Alpha: "), c("alpha_pct"), F.lit("pp"))).alias("line"))
