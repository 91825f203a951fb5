"""Calendars, as-of joins, intervals and forward windows, without products of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import cuts, with_range

FIRST, LAST = Window.unboundedPreceding, Window.unboundedFollowing


def clip(df: DataFrame, start, end, on: str = "date") -> DataFrame:
    """Both ends included."""
    return df.where(F.col(on).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def clamp_to_pre_oos(end: Column, start_of_oos) -> Column:
    return F.least(end.cast("date"), F.lit(start_of_oos).cast("date"))


def latest(bars: DataFrame) -> DataFrame:
    """ticker, price: the last close."""
    return bars.where("close is not null").groupBy("ticker").agg(F.max_by("close", "date").alias("price"), F.max("date").alias("date"))


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, columns: Sequence[str], forward: bool = False, exact: bool = True, ranges: int | None = None) -> DataFrame:
    """``left`` with the columns of the last row of ``right`` at or before (``forward``: at or after) its time, null if there is none; of several rows at that time the one with the greatest columns.

    A union and one window over ``by``. ``ranges`` cuts the times of all keys into so many ranges, each a group of its own into which the
    last row of the earlier ranges (forward: the first of the later ones) is carried, so one key may hold most of the rows. Without
    ``by`` only the distinct times of both sides meet; where these are more than days, ``ranges`` cuts them too.
    """
    if not by:
        days = left.select(on).where(F.col(on).isNotNull()).distinct()
        each = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.max(F.struct(*columns)).alias("r_")).select(on, "r_.*")
        found = asof(days.withColumn("all_", F.lit(0)), each.withColumn("all_", F.lit(0)), ["all_"], on, columns, forward, exact, ranges).drop("all_")
        return left.join(found, on, "left")
    right = right.where(F.col(on).isNotNull())
    kind = right.select(F.struct(*columns)).schema[0].dataType
    rows = left.select(*by, F.col(on).alias("at_"), F.struct("*").alias("l_"), F.lit(None).cast(kind).alias("r_"), F.lit(1 if exact else 0).alias("side_"))
    values = right.select(*by, F.col(on).alias("at_"), F.lit(None).cast(rows.schema["l_"].dataType).alias("l_"), F.struct(*columns).alias("r_"), F.lit(0 if exact else 1).alias("side_"))
    groups = list(by)
    if ranges and ranges > 1:
        at = cuts(left.select(on).unionByName(right.select(on)), on, ranges)
        values = with_range(values.groupBy(*by, "at_", "l_", "side_").agg(F.max("r_").alias("r_")), "at_", at)
        rows = with_range(rows, "at_", at).unionByName(values).unionByName(_carried_in(values, by, ranges, forward), allowMissingColumns=True)
        groups.append("range_")
    else:
        rows = rows.unionByName(values)
    order = [F.asc_nulls_first("carried_"), F.desc("at_") if forward else F.asc("at_"), F.asc("side_"), F.asc_nulls_first("r_")]
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(FIRST, 0)
    out = rows.withColumns({"carried_": F.when(F.col("side_") >= 0, 1)}).withColumn("found_", F.when(F.col("at_").isNotNull(), F.last("r_", ignorenulls=True).over(w))).where("l_ is not null")
    return out.select("l_.*", *[F.col("found_")[c].alias(c) for c in columns])


def _carried_in(values: DataFrame, by: Sequence[str], n: int, forward: bool) -> DataFrame:
    """Rows like those of ``asof`` (side_ -1) for each key and range: the last value of the nearest earlier range with one (forward: the first of the nearest later one)."""
    ends = values.groupBy(*by, "range_").agg((F.min_by if forward else F.max_by)("r_", "at_").alias("r_"))
    w, k = Window.partitionBy(*by).orderBy("range_"), F.col("range_")
    first, last = (F.coalesce(F.lag("range_").over(w), F.lit(0)), k - 1) if forward else (k + 1, F.coalesce(F.lead("range_").over(w), F.lit(n - 1)))
    ends = ends.withColumns({"first_": first, "until_": last}).where("first_ <= until_")
    return ends.select(*by, "r_", F.lit(-1).alias("side_"), F.explode(F.sequence("first_", "until_")).alias("range_"))


def next_bar(signals: DataFrame, bars: DataFrame, on: str = "signal_date") -> DataFrame:
    """Signals with entry_date and entry_price: the first bar after the signal and its open."""
    ahead = bars.select("ticker", F.col("date").alias(on), F.col("date").alias("entry_date"), F.col("open").alias("entry_price"))
    return asof(signals, ahead, ["ticker"], on, ["entry_date", "entry_price"], forward=True, exact=False)


def previous_bar(reviews: DataFrame, bars: DataFrame, on: str = "review_date") -> DataFrame:
    """Reviews (ticker, review_date) with score_date: the last bar strictly before."""
    return asof(reviews, bars.select("ticker", F.col("date").alias(on), F.col("date").alias("score_date")), ["ticker"], on, ["score_date"], exact=False)


def review_dates(days: DataFrame, start=None, end=None, frequency: str = "monthly") -> DataFrame:
    """review_date: the first trading day inside the range of each month or ISO week."""
    unit = {"monthly": "month", "weekly": "week"}[frequency]
    own = days if start is None else clip(days, start, end)
    return own.groupBy(F.date_trunc(unit, "date").alias("period_")).agg(F.min("date").alias("review_date")).select("review_date")


def config_on(days: DataFrame, labels: DataFrame, configs: DataFrame, on: str = "review_date", fallback: str = "neutral") -> DataFrame:
    """``days`` with the configuration in force: that of the last label (date, regime) at or before the day, the fallback's before the first or for a label without one.

    configs(name, ...) is a row for each regime; its columns are added.
    """
    x = asof(days, labels.where("regime is not null").select(F.col("date").alias(on), F.col("regime").alias("name")), [], on, ["name"])
    known = configs.select("name").withColumn("known_", F.lit(True))
    x = x.join(F.broadcast(known), "name", "left").withColumn("name", F.when(F.col("known_"), F.col("name")).otherwise(fallback)).drop("known_")  # a row for each regime
    return x.join(F.broadcast(configs), "name", "left").select(*days.columns, *configs.columns)


def weekday_review_dates(days: DataFrame, weekday: int = 1) -> DataFrame:
    """review_date: the first trading day at or after each such weekday (Monday is 0) of the range."""
    own = days.select("date").distinct()
    lo, hi = own.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        return own.select(F.col("date").alias("review_date"))
    wanted = own.sparkSession.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date")).where(F.weekday("date") == weekday)
    return asof(wanted, own.select("date", F.col("date").alias("review_date")), [], "date", ["review_date"], forward=True).where("review_date is not null").select("review_date").distinct()


def warmed_up(reviews: DataFrame, days: DataFrame, needed: int = 252) -> DataFrame:
    """The review dates with so many trading days of the whole table strictly before."""
    ranks = days.select("date").distinct().withColumn("before_", F.row_number().over(Window.orderBy("date")) - 1)  # one row a day
    return reviews.join(ranks, reviews["review_date"] == ranks["date"]).where(F.col("before_") >= needed).select("review_date")


def rolling_windows(spark, start: str, end: str, years: int = 2, step_months: int = 6) -> DataFrame:
    """window_start, window_end while a window ends in the range."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    starts = spark.range(1).select(F.explode(F.sequence(first, last, F.make_interval(months=F.lit(step_months)))).alias("window_start"))
    return starts.withColumn("window_end", F.add_months("window_start", 12 * years)).where(F.col("window_end") <= last)


def in_windows(rows: DataFrame, windows: DataFrame, on: str, length_months: int, step_months: int) -> DataFrame:
    """Each row once for every window [start, end) that holds it: the month of a start is computed from the row, not looked for."""
    low = windows.agg(F.min("window_start")).first()[0]
    k = F.floor(F.months_between(F.date_trunc("month", on), F.date_trunc("month", F.lit(low))) / step_months)
    spread = rows.withColumn("at_", F.explode(F.sequence(k - length_months // step_months - 1, k + 1)))
    spread = spread.withColumn("window_start", F.add_months(F.lit(low), (F.col("at_") * step_months).cast("int")))
    return spread.join(windows, "window_start").where((F.col(on) >= F.col("window_start")) & (F.col(on) < F.col("window_end"))).drop("at_")


def members_on(days: DataFrame, membership: DataFrame, end_counts: bool = True) -> DataFrame:
    """date, ticker: who is a member at each date of ``days``; several intervals count once. ``end_counts``: the day of removal is still one.

    An interval meets the months that it covers, and in these the dates.
    """
    far = days.agg(F.max("date")).first()[0]
    own = days.select("date").distinct().withColumn("month_", F.trunc("date", "month"))
    if far is None:
        return own.select("date", F.lit(None).cast(membership.schema["ticker"].dataType).alias("ticker"))
    until = F.coalesce("date_removed", F.lit(far))
    spans = membership.where((F.col("date_added") <= F.lit(far)) & (until >= F.col("date_added"))).withColumn("month_", F.explode(F.sequence(F.trunc("date_added", "month"), F.trunc(F.least(until, F.lit(far)), "month"), F.expr("interval 1 month"))))
    held = F.col("date_removed").isNull() | (F.col("date") <= F.col("date_removed") if end_counts else F.col("date") < F.col("date_removed"))
    return spans.join(own, "month_").where((F.col("date") >= F.col("date_added")) & held).select("date", "ticker").distinct()


def active_on(membership: DataFrame, day) -> DataFrame:
    """Tickers that are members on a day; one removed that day is not."""
    d = F.lit(day).cast("date")
    return membership.where((F.col("date_added") <= d) & (F.col("date_removed").isNull() | (F.col("date_removed") > d))).select("ticker").distinct()


def forward_bars(events: DataFrame, bars: DataFrame, after: str, days: int, bucket: int = 32) -> DataFrame:
    """Events with each bar of their ticker in (after, after + days]: joined by ticker and a bucket of days."""
    slot = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / bucket)
    from_ = F.date_add(F.col(after), 1)
    own = events.withColumn("slot_", F.explode(F.sequence(slot(from_), slot(F.date_add(F.col(after), days)))))
    there = bars.withColumn("slot_", slot(F.col("date")))
    return own.join(there, ["ticker", "slot_"]).where((F.col("date") > F.col(after)) & (F.col("date") <= F.date_add(F.col(after), days))).drop("slot_")


def following_bars(events: DataFrame, numbered: DataFrame, place: str, n: int, block: int = 64) -> DataFrame:
    """Events with each of the n bars behind their bar number ``place``: joined by ticker and a block of bars. ``numbered`` has ``i``."""
    own = events.withColumn("block_", F.explode(F.sequence(F.floor((F.col(place) + 1) / block), F.floor((F.col(place) + n) / block))))
    there = numbered.withColumn("block_", F.floor(F.col("i") / block))
    return own.join(there, ["ticker", "block_"]).where((F.col("i") > F.col(place)) & (F.col("i") <= F.col(place) + n)).drop("block_")
