"""Ranges of time, lanes and first passages against plain loops."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline import sources
from ledgerline.operators import exits as X
from ledgerline.operators import indicators as I
from ledgerline.operators import lanes, metrics, passage, ranges
from ledgerline.operators import timeline as T

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def walks(spark):
    return sources.random_walk(spark, 3, 900, 3).cache()


@pytest.mark.parametrize(("forward", "exact", "cut"), [(f, e, c) for f in (False, True) for e in (False, True) for c in (None, 2, 40)])
def test_asof_in_ranges(spark, forward, exact, cut):
    """One key holds 80 % of the rows; ties, null keys, times and values; a few values leave ranges without any."""
    r = random.Random(3)
    left = [(r.choice("aaaaaaaabc") if r.random() > 0.02 else None, DAY + datetime.timedelta(r.randrange(300)) if r.random() > 0.02 else None, i) for i in range(500)]
    right = [(r.choice("aaaaaaab"), DAY + datetime.timedelta(r.choice((5, r.randrange(300)))), r.randrange(5), None if r.random() < 0.1 else r.randrange(9)) for _ in range(120)]
    a, b = spark.createDataFrame(left, "k string, d date, n int"), spark.createDataFrame(right, "k string, d date, v int, w int")

    def nearest(k, d, by):
        ahead = lambda x: x[1] > d if forward else x[1] < d
        c = [x for x in right if d and (not by or x[0] == k) and (ahead(x) or exact and x[1] == d)]
        if not c:
            return None, None
        t = (min if forward else max)(x[1] for x in c)
        return max(((x[2], x[3]) for x in c if x[1] == t), key=lambda v: (v[0], v[1] is not None, v[1] or 0))

    for by in (["k"], []):
        got = {x.n: (x.v, x.w) for x in T.asof(a, b, by, "d", ["v", "w"], forward, exact, cut).collect()}
        assert got == {n: nearest(k, d, bool(by)) for k, d, n in left}
    assert T.asof(a, b.where("false"), ["k"], "d", ["v"], forward, exact, cut).where("v is null").count() == 500


def test_one_key_is_spread_over_the_ranges(spark):
    x = spark.range(1000).select(F.lit("a").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("d"))
    parts = {r["range_"]: r["count"] for r in ranges.with_range(x, "d", ranges.cuts(x, "d", 10)).groupBy("range_").count().collect()}
    assert set(parts) == set(range(10)) and max(parts.values()) <= 110


@pytest.mark.parametrize("size", [64, 300, 4096])
def test_lanes_equal_indicators(walks, size):
    want, got = I.indicators(walks, True).orderBy("ticker", "i").toPandas(), lanes.indicators(walks, True, size, 7).orderBy("ticker", "i").toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == len(want) == 2700
    for c in want.columns:
        if want[c].dtype.kind == "f":
            assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert (got[c].isna() & want[c].isna() | (got[c] == want[c])).all(), c


@pytest.mark.parametrize("cut", [1, 7, 100])
def test_drawdowns_merge(spark, walks, cut):
    curve = walks.select("ticker", "date", F.col("close").alias("portfolio_value"))
    got = {r.ticker: round(r.max_drawdown, 2) for r in ranges.drawdowns(curve, ["ticker"], ranges=cut).collect()}
    assert got == {r.ticker: r.max_drawdown for r in metrics.equity_stats(curve, by=["ticker"]).collect()}
    own = metrics.equity_stats(curve, by=["ticker"], rf=0.02).orderBy("ticker").collect()
    assert metrics.equity_stats(curve, by=["ticker"], rf=0.02, ranges=cut).orderBy("ticker").collect() == own
    one = curve.where("ticker = 'T001'")
    assert metrics.equity_stats(one, ranges=cut).collect() == metrics.equity_stats(one).collect()


def test_extremes_of_blocks(walks):
    bars = {}
    for r in I.numbered(walks).collect():
        bars.setdefault(r.ticker, {})[r.i] = r
    rows = passage.extremes(passage.blocks(I.numbered(walks), ["date", "high", "low"], size=8), 1, width=4).collect()
    assert sum(len(r.parts_) for r in rows) > 2 * 3 * 900 // 8 - 40
    for r in rows:
        for p in r.parts_:
            own = [bars[r.ticker][i] for i in range(8 * p.block, min(8 * p.block + 8, 900))]
            drop = max(h.high - low.low for k, low in enumerate(own) for h in own[: k + 1])
            assert (p.hi, p.lo, p.drop, p.last) == (max(b.high for b in own), min(b.low for b in own), drop, own[-1].date)


@pytest.mark.parametrize("how", [{}, {"trail": 0.4, "trigger": 3.0}, {"guard_days": 0, "max_hold": 30}, {"guard_days": 70, "horizon": 90}, {"horizon": 7, "realistic_fills": True}])
def test_first_passage_equals_every_bar(spark, walks, how):
    """Whatever the levels, the search by blocks finds what looking at every bar finds; repeated positions and such without a bar or an ATR stay."""
    numbered = I.indicators(walks)
    own = numbered.where("i >= 20 and i % 5 = 0").select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"), F.when(F.col("i") % 3 > 0, F.col("atr")).alias("atr"), (F.col("close") + 5 * F.col("atr")).alias("target_2"))
    own = own.unionByName(own.limit(3)).unionByName(own.limit(2).withColumn("entry_date", F.lit(DAY))).cache()
    p = {"max_hold": 365, "trail": 2.5, "guard_days": 15, "hard_floor": 3.0, "trigger": 1.0, "realistic_fills": False} | {k: v for k, v in how.items() if k != "horizon"}
    places = numbered.select("ticker", F.col("date").alias("entry_date"), F.col("i").alias("at_"))
    bars = numbered.select("ticker", "date", "i", "open", "high", "low", "close")
    rules = X._Phases(**p)
    want = X._every_bar(rules.levels(own).join(places, ["ticker", "entry_date"]), bars, rules, how.get("horizon", 300)).where("hit_ is not null").select(*own.columns, "hit_.*")
    got = X.three_phase(own, numbered, **how)
    assert got.count() == own.count()
    rows = sorted(map(str, want.collect()))
    assert sorted(map(str, got.where("exit_reason is not null").collect())) == rows and len(rows) > 40
