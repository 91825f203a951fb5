"""Every plan against the oracle's engine, and the traps of its semantics."""

import math
import os
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import monte_carlo
from ledgerline.plans import run as plans
from ledgerline.plans.catalog import ctes, regional

DIR = "/root/testdata/sf0.001"


def text(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{DIR}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_plan_equals_oracle(spark, oracle, name):
    df = plans.run(name, spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    found = oracle.execute(plans.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert got == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall())


def test_no_cartesian_product_in_asof(spark, oracle):
    plan = plans.run("asof_backward", spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rsi_against_recursion(spark, oracle):
    rows = plans.run("bars_daily", spark, DIR).where("ticker = (select min(ticker) from (select n_name as ticker from ledgerline_nation))").orderBy("date").collect()
    rsi = {(r.ticker, r.date): r.rsi for r in plans.run("rsi_wilder", spark, DIR).collect()}
    g = l = 0.0
    for i, (a, b) in enumerate(zip(rows, rows[1:]), 1):
        d = b.close - a.close
        g, l = g * 13 / 14 + max(d, 0), l * 13 / 14 + max(-d, 0)
        want = 50.0 if i < 14 or l == 0 else 100 - 100 / (1 + g / l)
        assert math.isclose(rsi[b.ticker, b.date], want, abs_tol=1e-3)


@pytest.mark.parametrize("method", ["bootstrap", "shuffle"])
def test_monte_carlo_equals_walked_paths(spark, method):
    pnl = [3.0, -2.5, 40.0, -60.0, 1.0, -8.0, 12.0] * 30 + [k / 7 for k in range(-40, 40)]
    trades = spark.createDataFrame([(p,) for p in [*pnl, None, math.nan, math.inf]], "pnl_pct double").repartition(3)
    held = monte_carlo.simulate(trades, 40, method=method, block=64).orderBy("simulation").collect()  # several parts to a path
    assert held == monte_carlo.simulate(trades, 40, method=method, block=64, hold=0).orderBy("simulation").collect()
    drawn, known = monte_carlo.Draws(len(pnl), method=method, block=64), sorted(pnl)
    assert len(held) == 40 and len({r.max_drawdown for r in held}) > 20
    for r in held:
        capital, peak, worst = 10000.0, 10000.0, 0.0
        for j in (path := drawn.path(r.simulation)):
            capital += capital / 5 * known[j] / 100
            peak = max(peak, capital)
            worst = min(worst, (capital - peak) / peak * 100)
        assert r.n_draws == len(path) == len(pnl) and (method == "bootstrap" or sorted(path) == list(range(len(pnl))))
        assert math.isclose(r.total_return, (capital / 10000 - 1) * 100, rel_tol=1e-9) and math.isclose(r.max_drawdown, worst, rel_tol=1e-9)


def test_monte_carlo_edges(spark, oracle):
    of = lambda *pnl: spark.createDataFrame([(p,) for p in pnl], "pnl_pct double")
    assert monte_carlo.simulate(of(None), 9).count() == 0 and monte_carlo.simulate(of(1.0), 0).count() == 0
    for hold in (0, 9):
        lost = monte_carlo.simulate(of(-700.0, -700.0, -500.0), 3, hold=hold, block=1).collect()
        assert {(r.total_return, r.max_drawdown, r.n_draws) for r in lost} == {(-100.0, -100.0, 3)}
        one = monte_carlo.simulate(of(10.0), 2, 7, "shuffle", hold=hold).collect()
        assert all(math.isclose(r.total_return, 2.0) and r.max_drawdown == 0 for r in one)
    rows = plans.queries()["monte_carlo_all_trades"](spark, DIR).collect()
    n = oracle.execute("select count(*) from lineitem").fetchone()[0]
    assert len(rows) == 2000 and {r.n_draws for r in rows} == {n}


def test_monte_carlo_ranks_what_happened(spark):
    pnl = [float(x) for x in np.random.default_rng(8).normal(0.3, 9, 90)]
    trades = spark.createDataFrame([(k // 4, k, p) for k, p in enumerate(pnl)], "day int, k int, pnl_pct double").repartition(3)
    path = np.r_[0, np.cumsum(np.log(1 + np.array(pnl) / 500))]
    known = monte_carlo.happened(trades, "day", ["k"], ranges=5)
    row = known.first()
    deepest = math.expm1((path - np.maximum.accumulate(path)).min()) * 100
    assert row.n_draws == 90 and math.isclose(row.log_growth, path[-1]) and math.isclose(row.max_drawdown, deepest)
    paths = monte_carlo.simulate(trades, 300, method="bootstrap").toPandas()
    b = monte_carlo.bands(spark.createDataFrame(paths), known).first()
    assert b.n_simulations == 300 and math.isclose(b.log_return_p5, round(np.percentile(paths.log_growth * 100, 5), 2), abs_tol=0.011)
    assert math.isclose(b.known_return_percentile, (paths.log_growth < path[-1]).mean() * 100, abs_tol=0.006) and math.isclose(b.known_drawdown_percentile, (paths.max_drawdown < deepest).mean() * 100, abs_tol=0.006)
    assert monte_carlo.happened(trades.where("false"), "day").count() == 0


def test_permutations_are_even():
    for n in (1, 2, 3, 60, 64, 65, 1000):
        assert sorted(monte_carlo.permuted(np.arange(n), n, [1, n])) == list(range(n))
    at = np.array([monte_carlo.permuted(np.arange(12), 12, [5, k]) for k in range(6000)])
    for place in range(12):  # 500 each; six deviations
        assert abs(np.bincount(at[:, place], minlength=12) - 500).max() < 6 * 500**0.5
    pairs = np.bincount(at[:, 0] * 12 + at[:, 1], minlength=144).reshape(12, 12)
    assert (pairs[~np.eye(12, dtype=bool)] > 15).all() and (pairs[~np.eye(12, dtype=bool)] < 90).all()


def test_draws_cost_little_of_a_core(spark):
    values = spark.createDataFrame([(k / 7, 600_000, 600_000 * k) for k in range(-30, 30)], "v_ double, c_ long, before_ long").withColumn("before_", F.expr("before_ + 18000000"))
    pnl, ends = np.arange(-30, 30) / 7, 600_000 * np.arange(1, 61)
    drawn, steps = monte_carlo.Draws(int(ends[-1]), method="shuffle"), monte_carlo.Steps(pnl, ends)
    at = drawn.numbers(3, drawn.parts - 1)
    out = np.empty(len(at))
    steps.put(at, out)
    assert len(steps.guide) <= 1 << 14 and (out == monte_carlo.growth(pnl)[at // 600_000]).all()
    # a run of draws of one part: it took over 150 ns each when the network worked on whole powers of four in 64 bits
    begin = time.process_time()
    for k in range(8):
        drawn.numbers(4, k)
    assert (time.process_time() - begin) / (8 * drawn.block) < 120e-9
    few = monte_carlo.simulate(None, 2, values=values).collect()
    assert {r.n_draws for r in few} == {36_000_000}


def test_bootstrap_costs_little_of_a_core(monkeypatch):
    pnl, ends = np.arange(-30, 30) / 7, 600_000 * np.arange(1, 61)
    drawn, steps, asked, real = monte_carlo.Draws(int(ends[-1])), monte_carlo.Steps(pnl, ends), [], monte_carlo.hashed
    out = np.empty(8 * drawn.block)
    for part, many in ((0, 3), (2, 8), (drawn.parts - 1, 1)):
        at = np.concatenate([drawn.numbers(5, part + k) for k in range(many)])
        lanes = steps.lanes(drawn, 5, part, many, out)
        assert (lanes.transpose(0, 2, 1).ravel()[: len(at)] == monte_carlo.growth(pnl)[at // 600_000]).all()
        assert lanes.transpose(0, 2, 1).ravel()[len(at) :].sum() == 0
        assert abs(np.bincount(at // 600_000, minlength=60) - len(at) / 60).max() < 6 * (len(at) / 60) ** 0.5
    monkeypatch.setattr(monte_carlo, "hashed", lambda key, places: asked.append(len(places)) or real(key, places))
    rng = np.random.default_rng(1)

    def seconds(run):
        begin = time.process_time()
        for k in range(8):
            run(k)
        return time.process_time() - begin

    whole = seconds(lambda k: monte_carlo.walked(steps.lanes(drawn, k, 0, 8, out)))
    assert 0 < sum(asked) < 0.002 * 8 * 8 * drawn.block
    # in terms of numpy's bounded integers alone, which were a part of it: it took some six times as long as these
    assert whole < 4 * seconds(lambda k: rng.integers(0, drawn.n, 8 * drawn.block))


def test_new_orders_are_looked_up():
    for n in (1, 2, 3, 60, 64, 65, 1000, 99_991):
        assert (monte_carlo.Order(n, (1, n)).numbers(0, n) == monte_carlo.permuted(np.arange(n), n, (1, n))).all()
    for n in (216_000_000, (1 << 33) + 7):
        assert (monte_carlo.Order(n, (1, 2)).numbers(n - 40_000, 40_000) == monte_carlo.permuted(np.arange(n - 40_000, n), n, (1, 2))).all()
    rng, out = np.random.default_rng(1), np.empty(8 * monte_carlo.BLOCK)
    for distinct, n in ((42, 700_001), (5000, 700_001), (1, 70_000)):  # few rows of numbers hold two returns, most do
        pnl, ends = np.sort(rng.normal(0, 3, distinct)), np.linspace(n / distinct, n, distinct).astype(np.int64)
        steps = monte_carlo.Steps(pnl, ends)
        for method in ("bootstrap", "shuffle"):
            drawn = monte_carlo.Draws(n, 7, method)
            found = [x for part, many in ((0, drawn.parts - 1), (drawn.parts - 1, 1)) for x in steps.walked(drawn, 3, part, min(many, 8), out)]
            wanted = [monte_carlo.walk(monte_carlo.growth(pnl)[np.searchsorted(ends, drawn.numbers(3, part), "right")]) for part in [*range(min(drawn.parts - 1, 8)), drawn.parts - 1]]
            assert found == wanted
    pnl, ends = np.arange(-30, 30) / 7, 3_600_000 * np.arange(1, 61)
    drawn, steps = monte_carlo.Draws(int(ends[-1]), method="shuffle"), monte_carlo.Steps(pnl, ends)

    def seconds(run):
        run(0)
        begin = time.process_time()
        for k in range(6):
            run(k)
        return time.process_time() - begin

    # in terms of a permutation whose rounds are computed: a walk along a new order took longer than that alone
    assert seconds(lambda k: steps.walked(drawn, 1, 8 * k, 8, out)) < 0.7 * seconds(lambda k: monte_carlo.permuted(np.arange(len(out)) + k, drawn.n, (1, 1)))


def test_growth_of_another_order_is_no_less(spark):
    paths = spark.createDataFrame([(7091.444012345678, -1.0), (7091.444012343, -3.0), (7090.0, -1.0), (7092.0, -1.0)], "log_growth double, max_drawdown double")
    known = spark.createDataFrame([(7091.444012345, -2.0)], "log_growth double, max_drawdown double")
    assert monte_carlo.bands(paths, known).first().known_return_percentile == 25.0


def test_bootstrap_draws_are_even(spark):
    at = np.array([monte_carlo.Draws(12).path(k) for k in range(6000)])
    for place in range(12):  # 500 each; six deviations
        assert abs(np.bincount(at[:, place], minlength=12) - 500).max() < 6 * 500**0.5
    pairs = np.bincount(at[:, 0] * 12 + at[:, 1], minlength=144)
    assert len(pairs) == 144 and pairs.min() > 10 and pairs.max() < 85
    x, rng = np.random.default_rng(2).integers(0, 1 << 64, 50, np.uint64), np.random.default_rng(3)
    for n in (1, 2, 36_000_000, (1 << 32) - 1, (1 << 33) + 7, (1 << 62) + 5):
        assert monte_carlo.below(n, x).tolist() == [int(v) * n >> 64 for v in x]
    assert monte_carlo.hashed(np.uint64(1234567), np.arange(3)).tolist() == [6457827717110365317, 3203168211198807973, 9817491932198370423]  # of the generator's reference
    for distinct in (20_000, 70_000):  # in some cells two returns meet, in most
        pnl = np.sort(rng.normal(0, 3, distinct))
        values = spark.createDataFrame([(float(v), 1, k) for k, v in enumerate(pnl)], "v_ double, c_ long, before_ long").coalesce(1)
        for r in monte_carlo.simulate(None, 3, block=3000, values=values).collect():
            path = np.r_[0, np.cumsum(monte_carlo.growth(pnl)[monte_carlo.Draws(distinct, block=3000).path(r.simulation)])]
            assert math.isclose(r.log_growth, path[-1], rel_tol=1e-9) and math.isclose(r.max_drawdown, math.expm1((path - np.maximum.accumulate(path)).min()) * 100, rel_tol=1e-9)


def test_numbers_beyond_32_bits_are_permuted():
    n = (1 << 33) + 7
    at = monte_carlo.permuted(np.r_[np.arange(5000), np.arange(n - 5000, n)], n, [1, 2])
    assert len(set(at)) == 10_000 and at.min() >= 0 and at.max() < n and at.std() > n / 4


def test_newey_west_errors(spark, oracle):
    months = {}
    for r in plans.sql(f"{ctes(regional(plans._Views()))} select * from bars", spark, DIR).orderBy("ticker", "date").collect():
        months.setdefault(r.ticker, {}).setdefault((r.date.year, r.date.month), []).append(r.close)
    got = {r.ticker: r for r in plans.run("ols_newey_west_hac", spark, DIR).collect()}
    assert set(got) == set(months)
    for ticker, per in months.items():
        y, x = (np.diff(np.log([c[k] for _, c in sorted(per.items())])) for k in (-1, 0))
        n = len(y)
        lags = int(np.floor(4 * (n / 100) ** (2 / 9)))
        a = np.column_stack([np.ones(n), x])
        inv = np.linalg.inv(a.T @ a)
        b = inv @ a.T @ y
        u = a * (y - a @ b)[:, None]
        s = u.T @ u
        for k in range(1, lags + 1):
            c = u[k:].T @ u[:-k]
            s = s + (1 - k / (lags + 1)) * (c + c.T)
        se = np.sqrt(np.diag(inv @ s @ inv * n / (n - 2)))
        r = got[ticker]
        assert lags > 0 and (r.n, r.lags) == (n, lags)
        assert np.allclose([r.alpha, r.beta, r.se_alpha, r.se_beta], [*b, *se], atol=6e-5)
