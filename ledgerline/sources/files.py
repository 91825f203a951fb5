"""Files of bars, positions, history, membership and run logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import upsert
from ..operators.timeline import clip
from . import snapshots

SCHEMAS = {
    "bars": "ticker string, date date, open double, high double, low double, close double, volume double",
    "positions": "ticker string, entry_date date, entry_price double, shares double, composite_score double, setup string, sector string, rsi double, pct_b double, z_score double, stoch_k double, stoch_d double, williams_r double, atr_percentile double, atr_regime string, vol_ratio double, pcr_volume double, pcr_signal string, avg_volume_m double, stop_loss double, target double, status string, exit_date date, exit_price double",
    "history": "date string, portfolio_value double, portfolio_return_pct double, spy_equivalent_value double, spy_return_pct double, alpha_pct double, n_open_positions long",
    "membership": "ticker string, date_added date, date_removed date",
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def bars(spark: SparkSession, path: str, start=None, end=None, tickers: Sequence[str] | None = None) -> DataFrame:
    """Bars of a Parquet table, both dates included; filters and columns reach the scan. NaN counts as missing, times as their day."""
    x = spark.read.parquet(path)
    if tickers is not None:
        x = x.where(F.col("ticker").isin(*tickers))
    x = x.withColumn("date", F.to_date("date"))
    if start is not None or end is not None:
        x = clip(x, start or "0001-01-01", end or "9999-12-31")
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return x.select("ticker", "date", *[clean(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def cached(spark: SparkSession, path: str, max_age_hours: float, load: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is younger; else what ``load`` gives, written there."""
    p, fs = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(p) or time.time() * 1000 - fs.getFileStatus(p).getModificationTime() > max_age_hours * 3_600_000:
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Columns by name; those that the file lacks are null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[(F.col(n).try_cast(t) if n in raw.columns else F.lit(None).cast(t)).alias(n) for n, t in _fields(kind)])


def _fields(kind: str) -> list[list[str]]:
    return [f.strip().split(" ") for f in SCHEMAS[kind].split(",")]


def ledger(spark: SparkSession, path: str, kind: str = "positions") -> DataFrame:
    """positions or history, as files of text or as a versioned table; an absent file is an empty table."""
    if snapshots.version(spark, path):
        return snapshots.read(spark, path, SCHEMAS[kind])
    return _csv(spark, path, kind) if exists(spark, path) else spark.createDataFrame([], SCHEMAS[kind])


def membership(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "membership")


def log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; blank lines and an absent file give nothing."""
    return spark.read.schema(schema).json(path).na.drop("all") if exists(spark, path) else spark.createDataFrame([], schema)


def table_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database; with a numeric key and its bounds it is read in parts."""
    own = {"url": url, "dbtable": table} | options
    if key and bounds:
        own |= {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**own).load()


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def rebuild_history(history: DataFrame, path: str) -> None:
    """The whole history anew, as the next version; running it again changes nothing that a reader sees."""
    snapshots.change(history.sparkSession, path, SCHEMAS["history"], lambda _: _typed(history, "history"))


def upsert_history(spark: SparkSession, path: str, rows: DataFrame, key: str = "date") -> None:
    """Replaces the rows of the same key and appends the others, in one step: a reader sees the old table or the new one, and of two writers both count."""
    snapshots.change(spark, path, SCHEMAS["history"], lambda old: upsert(old, _typed(rows, "history"), key))


def append_rows(rows: DataFrame, path: str, kind: str = "positions") -> None:
    """Adds rows to a versioned table, all of them or none."""
    snapshots.change(rows.sparkSession, path, SCHEMAS[kind], lambda _: _typed(rows, kind), append=True)


def _typed(df: DataFrame, kind: str) -> DataFrame:
    """The columns of a kind of table; those that are lacking are null."""
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in _fields(kind)])
