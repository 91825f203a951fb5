"""Exits of positions and of option paths, all at once.

What a day does depends on running extremes, and the first day with a reason is the exit.
Positions look for it by block extremes (``passage``); a call lives for a few blocks of
bars, which it reads in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finance
from .passage import SIZE, WIDTH, block_of, blocks, extremes, first_block, followed, spans_needed
from .timeline import asof, following_bars, forward_bars

FIRST = Window.unboundedPreceding
_HIT = "struct<exit_date: date, exit_price: double, exit_reason: string>"
_PRICES = ("date", "open", "high", "low", "close")
_LEVELS = ("entry_", "aim_", "floor_", "armed_", "room_")


def _once(df: DataFrame, name: str, value: str | Column) -> DataFrame:
    """Adds a dear column that later filters and columns read instead of computing it again: the optimizer does not look behind a generator."""
    return df.withColumn(name, F.explode(F.array(F.expr(value) if isinstance(value, str) else value)))


class _Phases:
    """The rules of ``three_phase`` as expressions: levels of a position, what a day does, whether a block of days may hold an exit."""

    def __init__(self, max_hold: int, trail: float | Column, guard_days: int, hard_floor: float | Column, trigger: float | Column, realistic_fills: bool):
        self.guard_days, self.trail, self.hard_floor, self.trigger = guard_days, trail, hard_floor, trigger
        hit = lambda price, reason: f"struct(cast(b.date as date) as exit_date, cast({price} as double) as exit_price, {reason} as exit_reason)"
        held = "datediff(b.date, entry_date)"
        fill = "if(b.open < stop, b.open, stop)" if realistic_fills else "stop"
        stop = f"case when {held} < {guard_days} then floor_ when top >= armed_ then greatest(top - room_, entry_) else entry_ end"
        name = f"concat('stop_', case when {held} < {guard_days} then 'guard' when top >= armed_ then 'trail' else 'breakeven' end)"
        #: what the day of bar b does when the peak, its high included, is ``top``
        self.day = f"transform(array({stop}), stop -> case when b.low <= stop then {hit(f'round({fill}, 2)', name)} when b.high >= aim_ then {hit('aim_', repr('target_2'))} when {held} >= {max_hold} then {hit('b.close', repr('max_hold'))} end)[0]"
        #: of a block behind the guarded days: always true if it holds an exit, and false but for a hair if it does not and the trail is no narrower than the trigger
        self.broken = f"""p.lo <= entry_ or p.hi >= aim_ or datediff(p.last, entry_date) >= {max_hold} or
          (greatest(s.peak, p.hi) >= armed_ and greatest(s.peak - p.lo, p.drop) >= room_ - 1e-9 * greatest(abs(greatest(s.peak, p.hi)), room_))"""

    def levels(self, positions: DataFrame) -> DataFrame:
        c = F.col
        atr = F.when(c("atr").isNull() | (c("atr") == 0), c("entry_price") * 0.02).otherwise(c("atr"))
        entry = c("entry_price").cast("double")
        return positions.withColumns({"entry_": entry, "aim_": c("target_2").cast("double"), "floor_": entry - self.hard_floor * atr, "armed_": entry + self.trigger * atr, "room_": self.trail * atr})

    def days(self, bars: str, peak: str) -> str:
        """(peak, hit) after the days of ``bars`` in order, up to the first hit."""
        return f"""aggregate({bars}, struct(cast({peak} as double) as peak, cast(null as {_HIT}) as hit),
          (s, b) -> if(s.hit is not null, s, transform(array(greatest(s.peak, cast(b.high as double))), top -> struct(top as peak, {self.day} as hit))[0]))"""


def three_phase(
    positions: DataFrame, numbered: DataFrame, max_hold: int = 365, horizon: int = 300, trail: float | Column = 2.5, guard_days: int = 15, hard_floor: float | Column = 3.0, trigger: float | Column = 1.0, realistic_fills: bool = False
) -> DataFrame:
    """positions(ticker, entry_date, entry_price, atr, target_2) -> adds exit_date, exit_price, exit_reason; null if none comes within ``horizon`` bars.

    Each day raises the peak by its high. In the first ``guard_days`` calendar days the stop is the hard floor; then the trail, not below
    the entry, once the peak has gained ``trigger`` ATRs; else the entry. Stop, target and longest hold are looked at in this order.
    Without an ATR 2 % of the entry stand in. ``realistic_fills``: a bar that opens below the stop fills there. ``trail``, ``hard_floor``
    and ``trigger`` may be columns of the positions, so that one pass runs a grid of them.

    The first bars, past the guard, are looked at one by one; then the first block that may hold an exit is found by its extremes and
    looked at bar by bar. A block that promised an exit and has none (levels a hair apart, or a trail narrower than the trigger)
    sends its position on the way of every bar. A ticker has one bar a day.
    """
    rules = _Phases(max_hold, trail, guard_days, hard_floor, trigger, realistic_fills)
    bars = blocks(numbered, _PRICES)
    places = bars.select("ticker", F.explode("bars_").alias("b_")).select("ticker", F.col("b_.date").alias("entry_date"), F.col("b_.i").alias("at_"))
    x = rules.levels(positions).join(places, ["ticker", "entry_date"], "left").select(*positions.columns, *_LEVELS, "at_", F.expr(f"floor((at_ + 1) / {SIZE})").alias("block_"))
    lead = max(0, -(-(guard_days - 1) // SIZE))  # blocks behind the first that the guard may reach into
    behind = f"filter(bars_, b -> b.i > at_ and b.i <= at_ + {horizon})"
    x = _once(x.join(followed(bars, lead), ["ticker", "block_"], "left"), "state_", rules.days(behind, "entry_")).drop("bars_")
    x = x.withColumn("span_", F.expr(f"if(state_.hit is null, floor((block_ + {lead + 1}) / {WIDTH}), null)")).join(extremes(bars, spans_needed(horizon)), ["ticker", "span_"], "left")
    found = first_block("parts_", f"block_ + {lead + 1}", f"floor((at_ + {horizon}) / {SIZE})", "state_.peak", rules.broken)
    x = _once(x, "found_", f"if(state_.hit is null, {found}, null)").drop("parts_", "span_", "block_").withColumn("block_", F.col("found_.block"))
    x = _once(x.join(bars, ["ticker", "block_"], "left"), "hit_", f"coalesce(state_.hit, {rules.days(behind, 'found_.peak')}.hit)")
    x = x.select(*positions.columns, *_LEVELS, "at_", "block_", "hit_").repartition("ticker", "entry_date")  # both ways below start from this shuffle
    missed = F.col("hit_").isNull() & F.col("block_").isNotNull()
    rest = _every_bar(x.where(missed).select(*positions.columns, *_LEVELS, "at_"), numbered, rules, horizon)
    return x.where(~missed).select(*positions.columns, "hit_.*").unionByName(rest.select(*positions.columns, "hit_.*"))


def _every_bar(own: DataFrame, numbered: DataFrame, rules: _Phases, horizon: int) -> DataFrame:
    """Positions with levels and places, and ``hit_`` from all bars of the horizon."""
    keys = own.columns
    x = following_bars(own.withColumn("row_", F.monotonically_increasing_id()), numbered.select("ticker", "i", *_PRICES), "at_", horizon)
    x = x.groupBy("row_", *keys).agg(F.sort_array(F.collect_list(F.struct("i", *_PRICES))).alias("bars_"))
    return x.withColumn("hit_", F.expr(f"{rules.days('bars_', 'entry_')}.hit"))


def option_paths(
    signals: DataFrame, numbered: DataFrame, dte: int = 45, max_hold: int = 40, iv: float = 0.38, rate: float = 0.04, stop_loss: float = 0.20, arm: float = 0.15, trail: float = 0.05, guard_days: int = 5, guard_floor: float = 0.40, least_forward: int = 5
) -> DataFrame:
    """signals(ticker, signal_date, ...) -> how an at-the-money call bought at the next open goes; signals without enough bars behind are left out.

    Days are bars. While guarded only the floor counts and no peak is kept; then the stop (on lows), arming (on highs, for good) and,
    once armed, the trail (on closes); else the last day closes. Marks are by Black-Scholes with the days that are left, one at least.
    The bars of a path come in one row of blocks, and its days are walked up to the first exit.
    """
    keys, c = signals.columns, F.col
    bars = numbered.select("ticker", "date", "i", "open", "high", "low", "close")
    ahead = bars.select("ticker", c("date").alias("signal_date"), c("date").alias("entry_date"), c("open").cast("double").alias("entry_price"), c("i").alias("at_"))
    x = asof(signals, ahead, ["ticker"], "signal_date", ["entry_date", "entry_price", "at_"], forward=True, exact=False).where(c("entry_price") > 0)
    x = x.withColumns({"premium_": finance.call_value(c("entry_price"), c("entry_price"), F.lit(dte / 365), rate, iv), "block_": block_of(c("at_") + 1)}).where("premium_ > 0")
    x = x.join(followed(blocks(bars, ["date", "high", "low", "close"]), -(-(max_hold - 1) // SIZE)), ["ticker", "block_"])
    x = x.withColumn("bars_", F.filter("bars_", lambda b: (b["i"] > c("at_")) & (b["i"] <= c("at_") + max_hold))).where(F.size("bars_") >= least_forward)
    floor, stop, arming = c("premium_") * (1 - guard_floor), c("premium_") * (1 - stop_loss), c("premium_") * (1 + arm)
    none = "struct<k: int, date: date, reason: string, value: double, stock: double, armed: boolean>"
    start = F.struct(F.lit(None).cast("double").alias("peak"), F.lit(False).alias("armed"), F.lit(None).cast(none).alias("hit"))

    def day(s, b):
        k = (b["i"] - c("at_")).cast("int")
        value = lambda p: finance.call_value(b[p].cast("double"), c("entry_price"), F.greatest(F.lit(dte) - k, F.lit(1)) / 365, rate, iv)
        hit = lambda reason, value, stock, armed: F.struct(k.alias("k"), b["date"].cast("date").alias("date"), F.lit(reason).alias("reason"), value.alias("value"), b[stock].cast("double").alias("stock"), armed.alias("armed"))
        last = k == F.size("bars_")
        guarded = F.struct(s["peak"].alias("peak"), s["armed"].alias("armed"), F.when(value("low") <= floor, hit("guard_floor", floor, "low", s["armed"])).when(last, hit("time_exit", value("close"), "close", s["armed"])).alias("hit"))

        def free(v):
            peak, armed = F.greatest(s["peak"], v["close"]), s["armed"] | F.coalesce(v["high"] >= arming, F.lit(False))
            exit_ = F.when(v["low"] <= stop, hit("stop_loss", stop, "low", s["armed"])).when(armed & (v["close"] <= peak * (1 - trail)), hit("trailing_stop", peak * (1 - trail), "close", armed)).when(last, hit("time_exit", v["close"], "close", armed))
            return F.struct(peak.alias("peak"), armed.alias("armed"), exit_.alias("hit"))

        marks = F.array(F.struct(*[value(p).alias(p) for p in ("high", "low", "close")]))  # an array, so that a lambda binds them once
        return F.when(s["hit"].isNotNull(), s).when(k <= guard_days, guarded).otherwise(F.transform(marks, free)[0])

    x = _once(x, "x", F.aggregate("bars_", start, day)).select(*keys, "entry_date", "entry_price", "premium_", "x.hit", "x.peak").where("hit is not null")
    pct = lambda a, b: F.round((a - b) / b * 100, 2)
    return x.select(
        *keys, "entry_date", F.round("entry_price", 2).alias("entry_price"), F.round("premium_", 2).alias("entry_premium"), c("hit.date").alias("exit_date"), c("hit.k").alias("days_held"), c("hit.reason").alias("exit_reason"),
        F.round("hit.value", 2).alias("exit_option_value"), pct(c("hit.value"), c("premium_")).alias("option_pnl_pct"), F.round("hit.stock", 2).alias("exit_stock_price"), pct(c("hit.stock"), c("entry_price")).alias("stock_pnl_pct"),
        c("hit.armed").alias("armed"), F.round(F.coalesce("peak", "premium_"), 2).alias("peak_option_value"),
    )


def option_summary(results: DataFrame) -> DataFrame:
    """By exit reason, and of all (exit_reason null): counts, share, means, medians, winners, how many were armed."""
    share: Column = F.count("*") / F.max("all_") * 100
    x = results.crossJoin(F.broadcast(results.agg(F.count("*").alias("all_"))))  # one row
    own = {
        "pct_of_total": (share, 1), "avg_option_pnl": (F.avg("option_pnl_pct"), 2), "avg_stock_pnl": (F.avg("stock_pnl_pct"), 2), "median_option_pnl": (F.percentile("option_pnl_pct", 0.5), 2), "win_rate_option": (F.count_if(F.col("option_pnl_pct") > 0) / F.count("*") * 100, 1),
        "win_rate_stock": (F.count_if(F.col("stock_pnl_pct") > 0) / F.count("*") * 100, 1), "pct_armed": (F.count_if("armed") / F.count("*") * 100, 1), "avg_days_held": (F.avg("days_held"), 1),
    }
    return x.rollup("exit_reason").agg(F.count("*").alias("n"), *[F.round(c, d).alias(k) for k, (c, d) in own.items()])


def stop_forensics(trades: DataFrame, bars: DataFrame, windows: tuple[int, ...] = (20, 40, 60), reasons: tuple[str, ...] = ("stop_guard", "stop_breakeven", "stop_trail"), mae_bars: int = 20) -> DataFrame:
    """Stopped trades with the return from the exit price after some calendar days, the worst low of the next bars, and the days to the first low below the exit.

    The bars behind a day are gathered once for each ticker and day; a trade compares its own price with them.
    """
    stopped = trades.where(F.col("exit_reason").isin(*reasons))
    c = F.col
    x = forward_bars(stopped.select("ticker", "exit_date").distinct(), bars.select("ticker", "date", "low", "close"), "exit_date", max(max(windows), 4 * mae_bars))
    after = F.datediff("date", "exit_date")
    x = x.withColumn("k_", F.row_number().over(Window.partitionBy("ticker", "exit_date").orderBy("date")))
    near = c("k_") <= mae_bars
    x = x.groupBy("ticker", "exit_date").agg(
        *[F.max_by(F.when(after <= w, c("close")), F.when(after <= w, c("date"))).alias(f"c_{w}") for w in windows],
        F.min(F.when(near, c("low"))).alias("worst_"), F.sort_array(F.collect_list(F.when(near, F.struct(after.alias("n"), "low")))).alias("lows_"),
    )
    gain = lambda p: F.round((p - c("exit_price")) / c("exit_price") * 100, 2)
    below = F.get(F.filter("lows_", lambda e: e["low"] < c("exit_price")), F.lit(0))["n"]
    own = {f"fwd_{w}d": gain(c(f"c_{w}")) for w in windows} | {"mae_post": gain(c("worst_")), "days_to_new_low": below}
    return stopped.join(x, ["ticker", "exit_date"]).withColumns(own).drop("worst_", "lows_", *[f"c_{w}" for w in windows])


def forensics_summary(stops: DataFrame, windows: tuple[int, ...] = (20, 40, 60)) -> DataFrame:
    """By exit reason and window: n, means, share that went up, median and mean return (what leaving has cost), and a verdict after 40 days."""
    long = stops.select("exit_reason", "pnl_pct", "mae_post", F.explode(F.create_map(*[x for w in windows for x in (F.lit(w), F.col(f"fwd_{w}d"))])).alias("window", "fwd"))
    up = F.count_if(F.col("fwd") > 0) / F.count("fwd") * 100
    x = long.groupBy("exit_reason", "window").agg(F.count("*").alias("n"), F.round(F.avg("pnl_pct"), 4).alias("avg_pnl_exit"), F.round(F.avg("mae_post"), 4).alias("avg_mae_post"), F.round(up, 4).alias("pct_up"), F.round(F.percentile("fwd", 0.5), 4).alias("median_fwd"), F.round(F.avg("fwd"), 4).alias("opp_cost"))
    limit = F.when(F.col("exit_reason") == "stop_breakeven", 65).when(F.col("exit_reason") == "stop_guard", 60).otherwise(55)
    return x.withColumn("verdict", F.when(F.col("window") == 40, F.when(F.col("pct_up") >= limit, F.when(F.col("exit_reason") == "stop_trail", "borderline").otherwise("issue")).when((F.col("exit_reason") == "stop_breakeven") & (F.col("pct_up") >= 50), "borderline").otherwise("ok")))


def stop_gap(trades: DataFrame, bars: DataFrame, slippage: float = 0.0005) -> DataFrame:
    """Stopped trades with gap_extra_pct: what an open below the stop would have cost, 0 if none; null without a bar that day."""
    return with_stop_gap(trades.where(F.col("exit_reason").startswith("stop_")), bars, slippage)


def with_stop_gap(trades: DataFrame, bars: DataFrame, slippage: float = 0.0005) -> DataFrame:
    """All trades with the gap_extra_pct of ``stop_gap``; null for those that no stop ended. Each meets the one bar of its exit."""
    own = bars.select("ticker", F.col("date").alias("exit_date"), F.col("open").alias("open_"))
    raw = F.col("exit_price") / (1 - slippage)
    extra = F.when(F.col("open_") < raw, (F.col("open_") - raw) / F.col("entry_price") * 100).when(F.col("open_").isNotNull(), 0.0)
    return trades.join(own, ["ticker", "exit_date"], "left").withColumn("gap_extra_pct", F.when(F.col("exit_reason").startswith("stop_"), extra)).drop("open_")


def stop_gap_summary(gaps: DataFrame, n_trades: int) -> DataFrame:
    hit = F.col("gap_extra_pct") < 0
    return gaps.agg(
        F.count("*").alias("n_stop_exits"), F.count("gap_extra_pct").alias("n_checked"), F.count_if(hit).alias("n_gapped_through"), F.round(F.count_if(hit) / F.count("gap_extra_pct") * 100, 4).alias("share_gapped_pct"),
        F.round(F.coalesce(F.avg(F.when(hit, F.col("gap_extra_pct"))), F.lit(0.0)), 4).alias("mean_extra_loss"), F.round(F.coalesce(F.sum("gap_extra_pct"), F.lit(0.0)) / n_trades, 6).alias("expectancy_impact_pp"),
    )
