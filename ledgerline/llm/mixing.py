"""Mixing sources to target weights: balanced sampling by the cube method.

A source's target over its size says how often each of its documents is taken: the
whole part for certain, the fraction as an inclusion probability. The flight moves
probabilities through the null space of two constraints, the expected number of
documents and of words, until each is 0 or 1: of three open units one always settles.
Sources are split into buckets by a hash, so a hot source is many groups; the at most
two units that a bucket leaves open meet at the next level, until a source's are one
group: the landing rounds its last two and turns single units to meet the words.

A unit is all rows with one doc_id, source and size; they share their fate.

Defined results: null or empty text has size 0 and takes nothing; null is a source of
its own, last in order; null doc_id is an id like any other; a source without words
has target 0; an empty table gives no rows; reruns agree (seeds are hashes).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, n_words, table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0  # weights of sources in order, repeating; part of all words; most of a source's own
BUCKET = 8192  # units of one flight
SMALL_SOURCES = 10_000  # sources whose table is broadcast


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> adds target. One row for each source: weights fill up to a common level, capped at ``most`` times the size.

    The place in the order is the place within a range partition plus the sources of the partitions before; the level
    rises, a sum over all sources at a time, until no further source is full.
    """
    by_name = F.col("source").asc_nulls_last()
    placed = durable(sizes.repartitionByRange(by_name).sortWithinPartitions(by_name).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "sources")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at") - F.shiftleft("part", 33)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    x = placed.join(F.broadcast(before), "part").select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    level, wanted = 0.0, share * (x.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        taken, rest = x.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        higher = (wanted - (taken or 0.0)) / rest if rest else float("inf")
        if higher <= level:
            break
        level = higher
    target = F.col("cap") if level == float("inf") else F.least(F.col("cap"), F.col("w") * F.lit(level))
    return x.select("source", "source_size", target.alias("target"))


def flight(p: np.ndarray, size: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Settles all but at most two of the probabilities; keeps the sums of weight * p and size * p."""
    p, r = p.copy(), np.random.default_rng(seed & 0x7FFFFFFF)
    luck = r.random(len(p) + 3)
    order = np.argsort(-size, kind="stable").tolist()  # large ones settle first, so what is left open is small
    active: list[int] = []
    at = step = 0
    while True:
        while len(active) < 3 and at < len(order):
            if 0 < p[order[at]] < 1:
                active.append(order[at])
            at += 1
        if len(active) < 3:
            return p
        a, b = weight[active], size[active]
        u = np.array([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
        if not u.any():
            u = np.array([a[1], -a[0], 0.0])
        x = p[active]
        up = min((1 - v) / d if d > 0 else -v / d for v, d in zip(x, u) if d)
        down = min(v / d if d > 0 else (v - 1) / d for v, d in zip(x, u) if d)
        x = x + up * u if luck[step % len(luck)] * (up + down) < down else x - down * u
        step += 1
        x[np.abs(x) < 1e-9] = 0.0
        x[np.abs(x - 1) < 1e-9] = 1.0
        p[active] = x
        active = [k for k in active if 0 < p[k] < 1]


def landing(p: np.ndarray, size: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rounds the last open units, then turns single units that were open at the start while that brings the words nearer to their expected sum."""
    free, open_ = np.flatnonzero((start > 0) & (start < 1)), np.flatnonzero((p > 0) & (p < 1))
    p = p.copy()
    p[open_] = np.round(p[open_])
    over = ((p - start) * size)[free].sum()
    for _ in range(3):
        change = np.where(p[free] == 1, -size[free], size[free])
        if not len(free) or abs(over + change[k := int(np.abs(over + change).argmin())]) >= abs(over):
            break
        p[free[k]] = 1 - p[free[k]]
        over += change[k]
    return p


def _fly(last: bool):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["h", "size"], kind="stable").reset_index(drop=True)
        mass = (g["size"] * g["m"]).to_numpy(float)
        start = g["p"].to_numpy(float)
        p = flight(start, mass, g["m"].to_numpy(float), int(g["h"].iloc[0]))
        g["p"] = landing(p, mass, start) if last else p
        return g

    return run


def decide(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, bucket: int = BUCKET) -> DataFrame:
    """rows(doc_id, source, size) -> doc_id, source, size, m (its rows), source_size, target, copies, a row for each unit."""
    units = durable(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    per = durable(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size")), weights, share, most), "targets")
    few = per.count() <= SMALL_SOURCES
    per_source = F.broadcast(per) if few else per
    x = units.join(per_source.withColumnRenamed("source", "s_"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    x = x.withColumn("base", whole.cast("long")).withColumn("p", F.greatest(F.lit(0.0), ratio - whole)).withColumn("h", F.xxhash64("doc_id", "source", "size"))
    x, settled, level = x.withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p"))), [], 0
    open_ = x
    while True:
        n = open_.groupBy("source").count().withColumnRenamed("source", "s_").withColumn("nb", F.ceil(F.col("count") / bucket).cast("long")).drop("count")
        most_buckets = (n.agg(F.max("nb")).first()[0]) or 1
        n = F.broadcast(n) if few else n
        dealt = open_.join(n, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("bucket", F.pmod(F.xxhash64("h", F.lit(level)), F.col("nb"))).drop("nb")
        last = most_buckets <= 1
        flown = durable(dealt.groupBy("source", "bucket").applyInPandas(_fly(last), dealt.schema).drop("bucket"), f"flight-{level}")
        settled.append(flown.where("p <= 0 or p >= 1"))
        if last:
            break
        open_, level = flown.where("p > 0 and p < 1"), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "m", "source_size", "target", (F.col("base") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: rows of ``docs`` with their columns, as often as they are taken."""
    size, *names, again = fresh(docs, "size_", "doc_id_", "source_", "mass_", "copies_", "copy_")
    rows = docs.withColumn(size, n_words(F.col("text")))
    taken = decide(rows.select("doc_id", "source", F.col(size).alias("size")), **how).where("copies > 0").select(*[F.col(c).alias(n) for c, n in zip(("doc_id", "source", "size", "copies"), names)])
    same = F.col("doc_id").eqNullSafe(F.col(names[0])) & F.col("source").eqNullSafe(F.col(names[1])) & (F.col(size) == F.col(names[2]))
    return rows.join(taken, same).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = decide(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size")))
    each = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
