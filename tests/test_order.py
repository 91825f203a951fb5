"""Order statistics, sweeps, choices, bootstraps and versioned tables against plain loops."""

import datetime
import os
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline import sources
from ledgerline.operators import choice, coverage, inference, metrics, order
from ledgerline.sources import snapshots

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def values(spark):
    """Distinct, repeated, negative and missing values; one value makes up a third; a null key; a key without values."""
    r = np.random.default_rng(3)
    rows = [(None if k % 7 == 6 else "abc"[k % 3], None if k % 11 == 0 else float(r.normal()) if k % 3 else 0.5, k) for k in range(600)] + [("none", None, 0)]
    return spark.createDataFrame(rows, "k string, v double, n int").repartition(3).cache(), pd.DataFrame(rows, columns=["k", "v", "n"])


@pytest.mark.parametrize("cut", [1, 5, 64])
def test_quantiles_are_exact(values, cut):
    x, p = values
    shares = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    got = {r.k: r for r in order.quantiles(x, "v", shares, ["k"], cut).collect()}
    for k, own in p.dropna(subset=["v"]).groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        assert np.allclose([got[k][n] for n in shares], own.v.quantile(list(shares.values())), atol=1e-12)
    one = order.quantiles(x, "v", shares, ranges=cut).first()
    assert np.allclose(list(one), p.v.quantile(list(shares.values())), atol=1e-12)
    assert list(order.quantiles(x.where("false"), "v", {"m": 0.5}, ranges=cut).first()) == [None]


@pytest.mark.parametrize("cut", [1, 5, 64])
def test_ranks_trims_and_running_sums(values, cut):
    x, p = values
    got = {r.n: r.rank for r in order.average_ranks(x.where("k is not null and k <> 'none'"), "v", "rank", cut).collect()}
    own = p[p.k.notna() & (p.k != "none")]
    want = own.v.rank()
    assert all(np.isclose(got[n], w) if not np.isnan(w) else got[n] is None for n, w in zip(own.n, want))
    s = np.sort(p.v.dropna())
    t = order.trimmed_mean(x, "v", 0.1, cut).first()
    c = int(0.1 * len(s))
    assert t.n == len(s) and np.isclose(t.trimmed, s[c:-c].mean())
    run = order.running(x.where("v is not null"), "v", "n", "upto", ["n"], cut).orderBy("v", "n").toPandas()
    assert (run["upto"] == run["n"].cumsum()).all()
    d = {r.k: r for r in metrics.describe(x, "v", ["k"]).collect()}
    assert d["none"].n == 0 and d["none"].p50 is None and d["a"].p75 == round(float(p[p.k == "a"].v.quantile(0.75)), 4) and len(d) == 5


def test_sweep_equals_counting(spark):
    r = random.Random(5)
    date = lambda: DAY + datetime.timedelta(r.randrange(400))
    rows = [(r.choice("abcdefgh"), date(), None if r.random() < 0.3 else date()) for _ in range(60)] + [("z", None, DAY)]
    days = [DAY + datetime.timedelta(17 * k - 40) for k in range(30)]
    m, d = spark.createDataFrame(rows, "ticker string, date_added date, date_removed date"), spark.createDataFrame([(x,) for x in [*days, days[0]]], "date date")
    want = {x: len({t for t, a, z in rows if a and a <= x and (z is None or x <= z)}) for x in days}
    assert {r.date: r.members for r in coverage.members_covered(m, d).collect()} == {x: n for x, n in want.items() if n}
    each = coverage.counts_on(m.na.fill({"ticker": "-"}), d, {"n": ("date_added", "date_removed")})
    assert {r.date: r.n for r in each.collect()} == {x: sum(bool(a and z and a <= x <= z) for _, a, z in rows) for x in days}


def test_planes_find_correlated_pairs(spark):
    """At the stated recall: pairs that move together or against each other are found, and only true ones are returned."""
    r = np.random.default_rng(8)
    base = r.normal(size=(12, 80))
    rows = []
    for k in range(60):
        v = (-1) ** (k % 2) * base[k % 12] + 0.3 * r.normal(size=80)
        rows += [(f"t{k:02d}", DAY + datetime.timedelta(d), float(x)) for d, x in enumerate(v) if k > 3 or d % 9]
    x = spark.createDataFrame(rows, "ticker string, date date, r double").cache()
    key = lambda df: {(a.a, a.b, a.n, round(a.corr, 9)) for a in df.collect()}
    exact, found = key(choice.correlated(x, 0.8, exact=True)), key(choice.correlated(x, 0.8))
    assert choice.recall(0.8) > 0.9 and found <= exact and len(exact) >= 12 * 10 and len(found) >= 0.9 * len(exact)
    assert any(c < 0 for *_, c in exact) or any(c > 0 for *_, c in exact)
    assert choice.candidates(x, 8, 8).count() < 60 * 59 / 2 / 2


@pytest.mark.parametrize(("limit", "dated", "holding"), [(None, False, False), (2, False, True), (1, True, False), (2, True, True)])
def test_greedy_choice_equals_a_loop(spark, limit, dated, holding):
    r = random.Random(11)
    names = [f"t{k}" for k in range(14)]
    sector = {t: r.choice(["a", "b", None]) for t in names}
    days = [DAY + datetime.timedelta(k) for k in range(12)]
    rows = [(d, t, float(r.randrange(5)), sector[t]) for d in days for t in names if r.random() < 0.7]
    pairs = [(d, a, b) for d in (days if dated else days[:1]) for a in names for b in names if a < b and r.random() < 0.25]
    held = [(d, f"h{k}", "a") for d in days[:5] for k in range(r.randrange(3))] + [(days[0], "t1", "b")] if holding else []
    held = [h for h in held if (h[0], h[1]) not in {(d, t) for d, t, *_ in rows}]
    want = []
    for d in days:
        inside, used = [t for x, t, _ in held if x == d], [s for x, _, s in held if x == d]
        place = 0
        for _, t, s in sorted((-score, t, s or "Unknown") for x, t, score, s in rows if x == d):
            bad = any({t, o} == {a, b} for x, a, b in pairs if x == d or not dated for o in inside)
            if len(inside) < 5 and not bad and (limit is None or used.count(s) < limit):
                place += 1
                inside.append(t)
                used.append(s)
                want.append((d, place, t))
    c = spark.createDataFrame(pairs, "date date, a string, b string")
    got = choice.greedy(spark.createDataFrame(rows, "date date, ticker string, score double, sector string"), 5, limit, c if dated else c.drop("date"), spark.createDataFrame(held, "date date, ticker string, sector string") if holding else None)
    assert sorted((x.date, x.place, x.ticker) for x in got.collect()) == want and len(want) > 30


def test_bootstrap_draws_clusters_evenly(spark):
    rows = [(datetime.date(2000 + k // 12, k % 12 + 1, 3), float(k % 5), 1.0) for k in range(36) for _ in range(1 + k % 3)]
    t = spark.createDataFrame(rows, "entry_date date, pnl_pct double, pnl double")
    means = np.array([r["mean"] for r in inference.cluster_bootstrap(t, draws=1500).collect()])
    own = np.array([(r.n, r.total) for r in inference.clusters(t).collect()], float)
    k = np.random.default_rng(1).integers(0, 36, (6000, 36))
    other = own[k, 1].sum(1) / own[k, 0].sum(1)
    assert len(means) == 1500 and abs(means.mean() - other.mean()) < 4 * other.std() / 1500**0.5 and abs(means.std() / other.std() - 1) < 0.08
    assert inference.cluster_bootstrap(t.where("false"), draws=10).count() == 0


SCHEMA = "date string, portfolio_value double"


def test_versions_stop_between_steps(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/h"
    rows = lambda *v: spark.createDataFrame([(f"d{k}", float(x)) for k, x in enumerate(v)], SCHEMA)
    now = lambda: sorted(tuple(r) for r in snapshots.read(spark, folder, SCHEMA).collect())
    assert now() == [] and snapshots.change(spark, folder, SCHEMA, lambda _: rows(1, 2)) == 1
    create = snapshots.create
    monkeypatch.setattr(snapshots, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))  # stops when data are written and the manifest is not
    with pytest.raises(KeyboardInterrupt):
        snapshots.change(spark, folder, SCHEMA, lambda _: rows(9))
    monkeypatch.setattr(snapshots, "create", create)
    assert now() == [("d0", 1.0), ("d1", 2.0)] and snapshots.version(spark, folder) == 1
    assert snapshots.change(spark, folder, SCHEMA, lambda _: rows(5), append=True) == 2
    assert now() == [("d0", 1.0), ("d0", 5.0), ("d1", 2.0)] and snapshots.read(spark, folder, SCHEMA, 1).count() == 2
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(rows(7), folder, 1)
    assert len(os.listdir(f"{folder}/data")) == 4 and not [n for n in os.listdir(f"{folder}/manifests") if n.count(".") > 1 and not n.startswith(".")]


def test_two_writers_at_once_both_count(spark, tmp_path):
    folder, barrier = f"{tmp_path}/h", threading.Barrier(2)
    full = lambda k: spark.createDataFrame([(f"d{k}", float(k))], SCHEMA)
    met = []

    def write(k):
        def to(old):
            if k not in met:  # both have read the same version before either commits
                met.append(k)
                barrier.wait()
            return old.unionByName(full(k))

        snapshots.change(spark, folder, SCHEMA, to)

    threads = [threading.Thread(target=write, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r.date for r in snapshots.read(spark, folder, SCHEMA).collect()) == ["d1", "d2"] and snapshots.version(spark, folder) == 2


def test_two_out_of_sample_runs_at_once(spark, tmp_path):
    """The second begins before the first has ended: only one is blind. A run that fails has been one."""
    folder, warned = str(tmp_path), []

    def run(inner=None):
        with pytest.warns(UserWarning, match="earlier") if warned or inner is None else _silent():
            return sources.single_shot(spark, folder, {"a": 1}, inner or (lambda: {"r": 2}), confirm=True)

    def first():
        warned.append(run())
        return {"r": 1}

    assert run(first) == {"r": 1} and warned == [{"r": 2}]
    with pytest.warns(UserWarning, match="2 earlier"), pytest.raises(ZeroDivisionError):
        sources.single_shot(spark, folder, {"a": 2}, lambda: 1 / 0, confirm=True)
    with pytest.warns(UserWarning, match="3 earlier"):
        sources.single_shot(spark, folder, {"a": 2}, dict, confirm=True)
    assert sources.log(spark, f"{folder}/oos_log", "run_at string, params_hash string").count() == 3


class _silent:
    def __enter__(self):
        return None

    def __exit__(self, *_):
        return False
