"""Stateful steps for streams; each also takes a plain table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import upsert_history


def daily_bars(ticks: DataFrame, late: str = "1 day") -> DataFrame:
    """ticks(ticker, ts, price, size) -> a bar for each ticker and day, final once ``late`` has passed."""
    at = F.struct("ts", "price")
    x = ticks.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "ticker")
    bars = x.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"))
    return bars.select("ticker", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def first_days(bars: DataFrame, late: str = "31 days") -> DataFrame:
    """review_date: the first day of each month that has a bar."""
    x = bars.select(F.col("date").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return x.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.to_date(F.min("ts")).alias("review_date"))


def signal_sessions(signals: DataFrame, gap: str = "4 days", late: str = "7 days") -> DataFrame:
    """signals(ticker, ts, score) -> runs of signals no further apart than ``gap``: first and last time, how many, the best score."""
    x = signals.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ticker")
    return x.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"), F.max("score").alias("best")).drop("w")


def upsert_batches(rows: DataFrame, path: str, checkpoint: str, key: str = "date") -> StreamingQuery:
    """Starts a query that puts each batch into the history; a batch that is run again replaces its own rows."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            last: Column = F.max_by(F.struct("*"), key)
            upsert_history(batch.sparkSession, path, batch.groupBy(key).agg(last.alias("x")).select("x.*"), key)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
