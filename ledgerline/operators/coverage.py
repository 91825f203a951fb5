"""Membership and how much of it the prices cover; survivorship."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from . import order
from .timeline import active_on, asof


def variants(membership: DataFrame, as_of) -> dict[str, DataFrame | None]:
    """Candidate universes: point in time, survivors with true dates, today's list since ever, none."""
    act = active_on(membership, as_of)
    return {
        "pit": membership, "survivors_true_dates": membership.join(act, "ticker", "left_semi"),
        "current_list_naive": act.select("ticker", F.lit("1900-01-01").cast("date").alias("date_added"), F.lit(None).cast("date").alias("date_removed")), "no_membership": None,
    }


def overlap(begin: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """Days from begin to end, and those of them that first to last covers; none without data."""
    days = F.greatest(F.datediff(end, begin), F.lit(0))
    covered = F.greatest(F.datediff(F.least(end, last), F.greatest(begin, first)), F.lit(0))
    return days, F.least(F.when(first.isNull() | last.isNull(), 0).otherwise(covered), days)


def spans(membership: DataFrame, bars: DataFrame, start: str, end: str, as_of) -> DataFrame:
    """Intervals inside the range: ticker, beg, end, fv and lv (first and last close), days, covered, survivor."""
    seen = bars.where("close is not null").groupBy("ticker").agg(F.min("date").alias("fv"), F.max("date").alias("lv"))
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    x = membership.select("ticker", F.greatest("date_added", s).alias("beg"), F.least(F.coalesce("date_removed", e), e).alias("end")).where(F.col("end") > F.col("beg"))
    x = x.join(seen, "ticker", "left").join(active_on(membership, as_of).withColumn("survivor", F.lit(True)), "ticker", "left").withColumn("survivor", F.coalesce("survivor", F.lit(False)))
    days, covered = overlap(F.col("beg"), F.col("end"), F.col("fv"), F.col("lv"))
    return x.withColumns({"days": days, "covered": covered})


def per_ticker(span: DataFrame) -> DataFrame:
    return span.groupBy("ticker").agg(F.sum("days").alias("days"), F.sum("covered").alias("covered"), F.min("beg").alias("first_member"), F.max("end").alias("last_member"), F.max("survivor").alias("survivor"))


def coverage(span: DataFrame) -> DataFrame:
    """group (all, survivors, non_survivors), n_tickers, company_days, covered_days, coverage_pct, n_fully_missing, n_partial."""
    x = per_ticker(span)
    group = F.when(F.grouping("survivor") == 1, "all").when(F.col("survivor"), "survivors").otherwise("non_survivors")
    return x.rollup("survivor").agg(
        group.alias("group"), F.count("*").alias("n_tickers"), F.sum("days").alias("company_days"), F.sum("covered").alias("covered_days"), F.round(F.sum("covered") / F.sum("days") * 100, 4).alias("coverage_pct"),
        F.count_if(F.col("covered") == 0).alias("n_fully_missing"), F.count_if((F.col("covered") > 0) & (F.col("covered") < F.col("days") * 0.98)).alias("n_partial"),
    ).drop("survivor")


def coverage_verdict(covered: DataFrame) -> DataFrame:
    side = lambda g: F.max(F.when(F.col("group") == g, F.col("coverage_pct")))
    x = covered.agg((side("survivors") - side("non_survivors")).alias("gap"))
    return x.select(F.round("gap", 4).alias("gap"), F.when(F.col("gap") > 2, "tilt").when(F.col("gap") < -2, "no_tilt").otherwise("negligible").alias("verdict"))


def coverage_by_year(span: DataFrame) -> DataFrame:
    """year, company_days, missing shares (percent) of all, survivors and others: an interval meets the years that it covers."""
    x = span.withColumn("year", F.explode(F.sequence(F.year("beg"), F.year("end"))))
    days, covered = overlap(F.greatest(F.col("beg"), F.make_date("year", F.lit(1), F.lit(1))), F.least(F.col("end"), F.make_date("year", F.lit(12), F.lit(31))), F.col("fv"), F.col("lv"))
    x = x.withColumns({"d_": days, "c_": covered})

    def missing(which: Column) -> Column:
        d, c = F.sum(F.when(which, F.col("d_"))), F.sum(F.when(which, F.col("c_")))
        return F.round(F.when(d > 0, (1 - c / d) * 100), 4)

    s = F.col("survivor")
    return x.groupBy("year").agg(F.sum("d_").alias("company_days"), missing(F.lit(True)).alias("missing_pct_all"), missing(s).alias("missing_pct_survivors"), missing(~s).alias("missing_pct_non_survivors"))


def counts_on(intervals: DataFrame, days: DataFrame, counts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """date and, for each named pair of columns (first and last day), how many intervals hold the dates of ``days``: a sweep.

    An interval is one up on its first day and one down behind its last; the sums of a day's steps add up, and a date takes the state of
    the last day with a step. Intervals never meet dates: what moves is a row for each day with a step, so the one window holds no more
    rows than the calendar has days. An interval that is null or ends before it begins counts nowhere.
    """
    steps = None
    for name, (first, last) in counts.items():
        own = intervals.where(F.col(last) >= F.col(first))
        one = own.select(F.explode(F.array(F.struct(F.col(first).alias("date"), F.lit(1).alias("step")), F.struct(F.date_add(last, 1).alias("date"), F.lit(-1).alias("step")))).alias("x")).select("x.*")
        one = one.groupBy("date").agg(F.sum("step").alias(name))
        steps = one if steps is None else steps.unionByName(one, allowMissingColumns=True)
    steps = steps.groupBy("date").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts])
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row for each day
    steps = steps.select("date", *[F.sum(n).over(w).alias(n) for n in counts])
    at = asof(days.select("date").where("date is not null").distinct(), steps, [], "date", list(counts))
    return at.fillna(0, list(counts))


def coverage_by_date(span: DataFrame, days: DataFrame) -> DataFrame:
    """date, n_members, n_covered, missing_share at the given dates; intervals count, both ends included."""
    own = span.withColumns({"c0_": F.greatest("beg", F.when(F.col("lv").isNotNull(), F.col("fv"))), "c1_": F.least("end", "lv")}).withColumn("c0_", F.when(F.col("fv").isNotNull() & F.col("lv").isNotNull(), F.col("c0_")))
    x = counts_on(own, days, {"n_members": ("beg", "end"), "n_covered": ("c0_", "c1_")}).where("n_members > 0")
    return x.withColumn("missing_share", F.round(1 - F.col("n_covered") / F.col("n_members"), 4))


def worst_partial(span: DataFrame, k: int = 15) -> DataFrame:
    x = per_ticker(span).where("covered > 0 and covered < days * 0.98").withColumn("missing_days", F.col("days") - F.col("covered"))
    return x.orderBy(F.desc("missing_days"), "ticker").limit(k).select("ticker", "days", "covered", "missing_days")


def missing_ranking(span: DataFrame) -> DataFrame:
    """Tickers without any data by member days, with their share and the running share."""
    x = per_ticker(span).where("covered = 0").select("ticker", "first_member", "last_member", F.col("days").alias("member_days"), (-F.col("days")).alias("order_"))
    x = order.running(x, "order_", "member_days", "upto_", ["ticker"]).crossJoin(F.broadcast(x.agg(F.sum("member_days").alias("all_"))))  # one row
    return x.select("ticker", "first_member", "last_member", "member_days", F.round(F.col("member_days") / F.col("all_") * 100, 4).alias("pct_of_missing"), F.round(F.col("upto_") / F.col("all_") * 100, 4).alias("cum_pct"))


def attribution(trades: DataFrame, membership: DataFrame, as_of) -> DataFrame:
    """By is_survivor: n, mean, median, win rate, profit, hold, delisted and guard exits, shares of trades and of profit."""
    x = trades.join(F.broadcast(active_on(membership, as_of)).withColumn("is_survivor", F.lit(True)), "ticker", "left").withColumn("is_survivor", F.coalesce("is_survivor", F.lit(False)))
    g = x.groupBy("is_survivor").agg(
        F.count("*").alias("n"), F.avg("pnl_pct").alias("mean"), F.var_samp("pnl_pct").alias("var"), F.percentile("pnl_pct", 0.5).alias("median"), (F.count_if(F.col("pnl_pct") > 0) / F.count("*") * 100).alias("win_rate"), F.sum("pnl").alias("sum_pnl"),
        F.avg(F.datediff("exit_date", "entry_date")).alias("avg_hold_days"), F.count_if(F.col("exit_reason") == "delisted").alias("n_delisted_exits"), F.count_if(F.col("exit_reason") == "stop_guard").alias("n_stop_guard_exits"),
    )
    all_ = Window.partitionBy()  # two rows
    return g.withColumns({"share_trades": F.col("n") / F.sum("n").over(all_) * 100, "share_pnl": F.col("sum_pnl") / F.sum("sum_pnl").over(all_) * 100, "mean_all": F.sum(F.col("n") * F.col("mean")).over(all_) / F.sum("n").over(all_)})


def attribution_test(attributed: DataFrame) -> dict[str, float] | None:
    """Welch's test of survivors against the others, and the bias if the others were simply absent."""
    rows = {r["is_survivor"]: r for r in attributed.collect()}
    if len(rows) < 2 or min(r["n"] for r in rows.values()) <= 2:
        return None
    s, n = rows[True], rows[False]
    t = tails.welch(s["mean"], s["var"], s["n"], n["mean"], n["var"], n["n"])
    return {"diff_mean": s["mean"] - n["mean"], "welch_t": t[0], "welch_p": t[1], "first_order_bias_pp": s["mean"] - s["mean_all"]} if t else None


def unknown_tickers(trades: DataFrame, membership: DataFrame) -> DataFrame:
    return trades.select("ticker").distinct().join(membership.select("ticker"), "ticker", "left_anti")


def selection_propensity(trades: DataFrame, membership: DataFrame, covered: DataFrame, as_of) -> DataFrame:
    """k: odds of later leavers among trades over their odds among covered company days."""
    known = trades.join(membership.select("ticker").distinct(), "ticker", "left_semi")
    gone = known.join(active_on(membership, as_of).withColumn("in_", F.lit(True)), "ticker", "left").agg(F.avg(F.col("in_").isNull().cast("double")).alias("s_tr"), F.count("*").alias("n_trades"))
    side = lambda g: F.max(F.when(F.col("group") == g, F.col("covered_days")))
    days = covered.agg((side("non_survivors") / (side("survivors") + side("non_survivors"))).alias("s_days"))
    x = gone.crossJoin(days)  # one row each
    inside = lambda c: (F.col(c) > 0) & (F.col(c) < 1)
    k = (F.col("s_tr") / (1 - F.col("s_tr"))) / (F.col("s_days") / (1 - F.col("s_days")))
    return x.select("n_trades", F.round("s_tr", 6).alias("share_trades_non_survivor"), F.round("s_days", 6).alias("share_days_non_survivor"), F.round(F.when(inside("s_tr") & inside("s_days"), k), 6).alias("k_empirical"))


def missing_data_bound(trades: DataFrame, by_date: DataFrame, ks: Sequence[float] = (1.0, 2.0, 3.0), scenarios: Mapping[str, float] | None = None) -> DataFrame:
    """k, scenario, ghost trades, their return, the expectancy with them, its change, and the return at which it would be 0.

    Ghosts: entries of a month times missing over covered members of that month, times k.
    """
    entries = trades.groupBy(F.trunc("entry_date", "month").alias("month")).agg(F.count("*").alias("e"))
    ratio = by_date.select(F.trunc("date", "month").alias("month"), F.try_divide(F.col("n_members") - F.col("n_covered"), F.col("n_covered")).alias("r"))
    ghosts = entries.join(ratio, "month", "left").agg(F.sum(F.col("e") * F.coalesce("r", F.lit(0.0))).alias("ghost"))
    side = lambda v, least: F.when(F.count_if(F.col("exit_reason") == v) >= least, F.avg(F.when(F.col("exit_reason") == v, F.col("pnl_pct"))))
    own = trades.agg(F.count("pnl_pct").alias("n"), F.avg("pnl_pct").alias("mu"), side("stop_guard", 5).alias("guard"), side("delisted", 3).alias("delisted"))
    fixed = {"-30% (gap through the stop)": -30.0, "-60% (distress)": -60.0, "-100% (bankruptcy)": -100.0} | dict(scenarios or {})
    table = F.create_map(*[x for name, v in fixed.items() for x in (F.lit(name), F.lit(v))], F.lit("avg stop_guard exit"), F.col("guard"), F.lit("avg delisted exit"), F.col("delisted"))
    x = ghosts.crossJoin(own).select("ghost", "n", "mu", F.explode(table).alias("scenario", "x")).where("x is not null").withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in ks])))  # one row each
    g = F.col("ghost") * F.col("k")
    adjusted = (F.col("n") * F.col("mu") + g * F.col("x")) / (F.col("n") + g)
    return x.select("k", "scenario", F.round(g, 4).alias("ghost_trades"), F.round("x", 4).alias("ghost_return_pct"), F.round(adjusted, 4).alias("adj_expectancy_pct"), F.round(adjusted - F.col("mu"), 4).alias("delta_pp"), F.round(F.when((g > 0) & (F.col("mu") > 0), -F.col("n") * F.col("mu") / g), 4).alias("breakeven_pct"))


def universe_sample(tickers: DataFrame, n: int, seed: int) -> DataFrame:
    """n tickers at random, the same for a seed."""
    return tickers.select("ticker").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("ticker").cast("string"))), "ticker").limit(n)


def delisting_check(trades: DataFrame, bars: DataFrame, grace_days: int = 10) -> DataFrame:
    """Traded tickers with their last bar, and whether they still trade at the end of the table."""
    last = bars.where("close is not null").groupBy("ticker").agg(F.max("date").alias("last_date"))
    x = trades.select("ticker").distinct().join(last, "ticker", "left").crossJoin(bars.agg(F.max("date").alias("end_")))  # one row
    return x.select("ticker", "last_date", F.coalesce(F.col("last_date") >= F.date_sub("end_", grace_days), F.lit(False)).alias("still_trading"))


def merged(membership: DataFrame) -> DataFrame:
    """Intervals of a ticker that overlap or touch become one, so that each of its days is held once. Without an end: the last day there is."""
    x = membership.where("date_added is not null").select("ticker", "date_added", F.coalesce("date_removed", F.lit("9999-12-30").cast("date")).alias("date_removed")).where("date_removed >= date_added")
    w = Window.partitionBy("ticker").orderBy("date_added", "date_removed")  # the intervals of one ticker
    before = F.max("date_removed").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("run_", F.sum(F.when(F.col("date_added") <= F.date_add(before, 1), 0).otherwise(1)).over(w))
    return x.groupBy("ticker", "run_").agg(F.min("date_added").alias("date_added"), F.max("date_removed").alias("date_removed")).drop("run_")


def members_covered(membership: DataFrame, days: DataFrame) -> DataFrame:
    """date, members: how many tickers are members at each date, those removed on it included."""
    return counts_on(merged(membership), days, {"members": ("date_added", "date_removed")}).where("members > 0")
