"""What is dear to make is made once, however often an operator uses it."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerline.operators import diagnostics, exits, inference, metrics, monte_carlo, order
from ledgerline.operators import backtest as B
from ledgerline.operators.presence import matched
from ledgerline.plans import library

DIR = "/root/testdata/sf0.001"
N = 400


@pytest.fixture
def counted_rows(spark):
    """Trades and the number of their rows that were read so far."""
    reads = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    own = spark.range(N).select(F.date_add(F.lit("1995-01-01").cast("date"), F.col("id").cast("int") * 3).alias("entry_date"), F.expr("cast((id * 37) % 101 - 40 as double)").alias("pnl_pct"), F.expr("cast((id * 53) % 89 as double)").alias("pnl"), F.expr("cast(id % 11 as double)").alias("signal_score"))
    return own.mapInPandas(run, own.schema), reads


@pytest.mark.parametrize("use", [
    lambda t: inference.trade_significance(t, draws=20),
    lambda t: metrics.top_removed(t).collect(),
    lambda t: metrics.spearman(t, "signal_score", "pnl_pct").collect(),
    lambda t: order.counted(t, "pnl").collect(),
    lambda t: order.quantiles(t, "pnl", {"a": 0.3}).collect(),
    lambda t: diagnostics.correlation_audit(t, "spearman", columns=["pnl", "pnl_pct", "signal_score"]).collect(),
])
def test_trades_are_read_once(counted_rows, use):
    trades, reads = counted_rows
    use(trades)
    assert reads.value == N


def test_spearman_of_pairs(spark):
    rows = [(1.0, 2.0), (1.0, 2.0), (2.0, 5.0), (3.0, 1.0), (None, 4.0), (7.0, None), (9.0, 9.0), (2.0, 5.0), (-0.0, 0.0)]
    x = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    got = metrics.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()[0]
    assert math.isclose(got, round(x.a.rank().corr(x.b.rank()), 4))
    assert metrics.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()[0] is None


def test_runs_are_folded_once(spark):
    t = library.Tables(spark, DIR)
    panel, world, bars = library._world(spark, DIR, t=t)
    for made in (bars, panel, t.held(), B.run(panel, [library._BASE], world)):
        assert not any("lineitem" in f for f in made.inputFiles())


def test_gaps_meet_trades_in_place(spark):
    t = library.Tables(spark, DIR)
    x = exits.with_stop_gap(t.trades(), t.daily())
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and x.count() == t.trades().count()
    assert x.where("exit_reason not like 'stop_%' and gap_extra_pct is not null").count() == 0


def test_asof_carries_what_it_needs(spark):
    plan = library.QUERIES["asof_in_ranges"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "stop_breakeven" not in plan and "neutral" not in plan  # neither exit reasons nor regimes are made


@pytest.mark.parametrize("others", [[1, 2, 3, 4, 5], [1, 2, 2, 5, 5, 5, None, 9], []])
def test_matched_rows_are_those_of_a_join(spark, others):
    rows = spark.createDataFrame([(k, f"{k}{n}") for k in (1, 1, 2, 3, 5, 5, 7, None) for n in range(3)], "on long, x string")
    there = spark.createDataFrame([(k,) for k in others], "key long")
    assert sorted(matched(rows, "on", there, "key").collect()) == sorted(rows.join(there, rows.on == there.key).drop("key").collect())


@pytest.mark.parametrize("query,module,name", [("pnl_quantiles", order, "quantiles"), ("spearman_by_counts", metrics, "spearman"), ("top_removed", metrics, "top_removed"), ("monte_carlo_all_trades", monte_carlo, "simulate")])
def test_items_stay_where_only_keys_are_met(spark, monkeypatch, query, module, name):
    given, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(module, name, lambda trades, *_, **__: given.append(trades) or spark.createDataFrame([], "exit_reason string, p5 double, p25 double, p50 double, p75 double, p99 double"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4000)  # orders are larger, as they are at 1 GB
    try:
        __spark_entry__.queries()[query](spark, DIR)
        plan = given[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plan and given[0].count() == spark.read.parquet(f"{DIR}/lineitem.parquet").count()
