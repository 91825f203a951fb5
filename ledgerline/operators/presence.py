"""Inner joins that take no column from the other side: keys travel, rows stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keep import kept


def matched(rows: DataFrame, on: str, others: DataFrame, key: str) -> DataFrame:
    """``rows`` as an inner join with ``others`` leaves them: each as often as its key occurs there.

    Only the distinct keys of both sides are shuffled. Those of ``rows`` that the others do not hold exactly once, mostly none, are kept;
    the rows meet these, in a broadcast while they are small, in a shuffle if they are many.
    """
    rows = rows.where(F.col(on).isNotNull())
    own, there = rows.select(F.col(on).alias("key_")).distinct(), others.groupBy(F.col(key).alias("key_")).agg(F.count("*").alias("times_"))
    odd = own.join(there, "key_", "left").select("key_", F.coalesce("times_", F.lit(0)).alias("times_")).where("times_ <> 1")
    odd = kept(odd, "odd_keys")
    met = rows.join(odd, F.col(on) == F.col("key_"), "left").where("times_ is null or times_ > 0")
    if not odd.where("times_ > 1").isEmpty():
        met = met.withColumn("times_", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times_").cast("int"), F.lit(1)))))
    return met.drop("key_", "times_")
