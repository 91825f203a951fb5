"""Plans on a session's tables, and the same plans as the oracle's SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import monte_carlo
from ..operators.presence import matched
from .catalog import PROFITS, REASON, plans
from .dialect import Duck, Spark

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class _Views(Spark):
    def t(self, table: str) -> str:
        return f"ledgerline_{table}"


class _Oracle(Duck):
    def t(self, table: str) -> str:
        return table


_DECIMAL = re.compile(r"'[^']*'|(?<![\w.])(\d+\.\d+)(?![\w.])")


def _doubles(text: str) -> str:
    """Decimal literals as doubles, outside of strings: neither engine then rounds quotients to a decimal's scale."""
    return _DECIMAL.sub(lambda m: f"{m[1]}e0" if m[1] else m[0], text)


@lru_cache(1)
def spark_plans() -> dict[str, str]:
    return {name: _doubles(text) for name, text in plans(_Views()).items()}


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's result; only the tables it names are read."""
    return sql(spark_plans()[name], spark, sf_dir)


def sql(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    for table in TABLES:
        if f"ledgerline_{table}" in text:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"ledgerline_{table}")
    return spark.sql(text)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades (``catalog.trades``) with what their items alone tell: pnl_pct, pnl, signal_score, exit_reason. Of orders, parts and suppliers only the keys are met."""
    t = lambda name: f"ledgerline_{name}"
    x = sql(_doubles(f"select l_orderkey, l_partkey, l_suppkey, {PROFITS}, {REASON} from {t('lineitem')}"), spark, sf_dir)
    placed = sql(f"select s_suppkey from {t('supplier')} join {t('nation')} on s_nationkey = n_nationkey join {t('region')} on n_regionkey = r_regionkey", spark, sf_dir)
    x = matched(x, "l_suppkey", placed, "s_suppkey")
    for on, table, key in (("l_partkey", "part", "p_partkey"), ("l_orderkey", "orders", "o_orderkey")):
        x = matched(x, on, sql(f"select {key} from {t(table)}", spark, sf_dir), key)
    return x.drop("l_orderkey", "l_partkey", "l_suppkey")


def all_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bootstrap with as many draws as there are trades: too many rows for SQL, so it has no oracle."""
    return monte_carlo.simulate(outcomes(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run, name) for name in spark_plans()} | {"monte_carlo_all_trades": all_trades}


def oracle_sql() -> dict[str, str]:
    return {name: _doubles(text) for name, text in plans(_Oracle()).items()}
