"""Near-duplicates: min-max hashing.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Each of
PERMUTATIONS multipliers permutes the hashes once and gives two values, the minimum and
the maximum; a band joins BAND of these values. At a similarity of 0.85 a pair misses
all 32 bands with a chance below 4e-5, at 0.9 below 1e-7; pairs well below meet seldom.
Below PERCENT 42 bands of 6 take their place: at 0.8 a pair misses with a chance of 3e-6.
Equal sets form one class first (a copy is not compared again), and only classes meet
in buckets.

A bucket never expands into all pairs. Its members are compared with one hub, the
member with the most bucket mates; every pair is confirmed on the full sets, and links
make components. What then remains are pairs of bucket mates of different components.
They are found exactly by a prefix join over the full sets of all classes in such
buckets: shingles are ordered from rare to common, and two sets that are similar
enough share one of the first few, at places that leave room for the rest. So no link
between bucket mates is lost, at any size of bucket, and a group whose members are
alike but do not link is told apart by its rare shingles instead of pair by pair.

Defined results: null, empty and blank text has an empty set and is linked with
nothing; fewer than five words make one shingle; rows that repeat a doc_id count as
texts of their own and share the id's name; a null doc_id takes no part: its
component_id is null and it is kept; an empty table gives no rows; extra columns stay
out of the way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, durable, forget, fresh, release, table

SHINGLE, PERCENT = 5, 85
PERMUTATIONS, BAND = 128, 8  # 256 values in 32 bands
WIDE = 6  # values of a band where less than PERCENT is asked for: 42 bands of the first 252 values
BLOCK = 512  # shingles that are permuted at once
AT_ONCE = 1000  # texts whose sets are held at once
_LOWER = {c: c + 32 for c in range(65, 91)}
_UPPER = re.compile("[A-Z]")


@lru_cache(1)
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    a, b = r.integers(0, 1 << 32, (2, PERMUTATIONS, 1), np.uint32)
    return a | np.uint32(1), b


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of shingle hashes; remembers the hashes of words, up to LIMIT."""

    LIMIT = 250_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word.encode(errors="surrogatepass"), digest_size=8).digest(), "little")
        return h

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes."""
        words = WORD.findall(text.translate(_LOWER) if _UPPER.search(text) else text) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known = self.known
        try:
            h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            h = np.array([known[w] if w in known else self._hash(w) for w in words], np.uint64)
        n = max(1, len(h) - SHINGLE + 1)
        out = np.full(n, len(h) if len(h) < SHINGLE else SHINGLE, np.uint64)
        for k in range(min(SHINGLE, len(h))):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(out)


def bands(shingles: np.ndarray, band: int = BAND) -> np.ndarray:
    a, b = multipliers()
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    low, top = [], []
    for at in range(0, len(high), BLOCK):
        v = a * high[at : at + BLOCK] + b
        low.append(v.min(axis=1))
        top.append(v.max(axis=1))
    values = np.concatenate([np.min(low, axis=0), np.max(top, axis=0)]).astype(np.uint64)
    rows = values[: len(values) // band * band].reshape(-1, band)
    key = np.arange(len(rows), dtype=np.uint64)
    for j in range(band):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class (null for an empty set), bands."""
    band = BAND if percent >= PERCENT else WIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in _slices(batches):
            sets = list(map(shingler.set_of, batch.column("text").to_pylist()))
            of = [class_of(s) if len(s) else None for s in sets]
            found = [bands(s, band) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(of, pa.int64()), _lists(found)], ["doc_id", "n_shingles", "class", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, s: the sets of the classes in ``wanted`` (class, doc_id of one document with that text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in _slices(batches):
            sets = map(shingler.set_of, batch.column("text").to_pylist())
            same = [(c, s) for c, s in zip(batch.column("class").to_pylist(), sets) if len(s) and class_of(s) == c]  # an id may stand for several texts
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in same], pa.int64()), _lists([s.view(np.int64) for _, s in same])], ["class", "s"])

    return docs.select("doc_id", "text").join(wanted, "doc_id").select("class", "text").mapInArrow(run, "class long, s array<long>").dropDuplicates(["class"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    x = pairs.join(sets.select(F.col("class").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return x.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("n")).where(f"100 * i >= {percent} * (n - i)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the nodes of ``edges`` (a, b): least labels spread and pointers are halved until nothing changes."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    written = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        labels = written.select("node", "component")
        heard = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(heard, "node").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("higher"))
        moved = durable(step.join(up, "next").select("node", F.least("next", "higher").alias("component"), "was"), "labels")
        forget(written)
        written = moved
        if moved.where("component <> was").isEmpty():
            forget(both)
            return moved.select("node", "component")


def hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member of a bucket with the bucket's hub."""
    weight = members.groupBy("class").agg(F.sum("size").alias("weight"))
    hub = durable(members.join(weight, "class").groupBy("bucket").agg(F.max(F.struct("weight", F.col("class").alias("hub"), F.col("n").alias("hub_n"))).alias("x")).select("bucket", "x.hub", "x.hub_n"), "hubs")
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = members.join(hub, "bucket").where((F.col("hub") != F.col("class")) & alike).select(F.least("class", "hub").alias("a"), F.greatest("class", "hub").alias("b")).distinct()
    out = durable(pairs, "pairs")
    forget(hub)
    return out


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """rows(class, n, component, s) -> pairs (a, b) of different components that may be similar enough; none that is gets lost.

    A set of n needs ``percent`` of n common shingles at least, so one of them is among its first n - that + 1, and among
    fewer where the other set is no smaller. A shingle that one set alone holds is rarest, and only counts as a place.
    """
    tokens = rows.select("class", F.explode("s").alias("token"))
    often = durable(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    listed = tokens.join(often, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    ordered = listed.join(rows.select("class", F.col("n").cast("long").alias("n"), "component"), "class").withColumn("alone", F.col("n") - F.size("t"))
    ordered = ordered.withColumn("probe", F.expr(f"n - ({percent} * n + 99) div 100 + 1")).withColumn("index", F.expr(f"n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + 1"))
    first = F.expr("slice(t, 1, cast(greatest(probe - alone, 0) as int))")
    prefix = durable(ordered.select("class", "n", "component", "index", "alone", F.posexplode(first).alias("k", "x")).select("class", "n", "component", "index", (F.col("alone") + F.col("k")).alias("at"), F.col("x.token").alias("token")), "prefixes")
    x = prefix.where("at < index").select("token", F.col("class").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"), F.col("at").alias("ia"))
    y = prefix.select("token", F.col("class").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("at").alias("ib"))
    smaller = F.expr("na < nb or (na = nb and a < b)")
    room = F.expr(f"100 * na >= {percent} * nb and least(na - ia, nb - ib) >= ({percent} * (na + nb) + {99 + percent}) div {100 + percent}")
    met = x.join(y, (x["token"] == y["token"]) & smaller & (F.col("ca") != F.col("cb")) & room)
    out = durable(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    forget(often, prefix)
    return out


def merge(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (node, component) after further ``links`` (a, b) between nodes, known or not."""
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    x = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    joined = components(x)
    old = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return durable(old.unionByName(joined.join(found, "node", "left_anti")), "labels")


def link_classes(docs: DataFrame, signed: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """class, doc_id (the least of its documents), n, bands of all classes; node, component of those that are linked with another one."""
    classes = durable(signed.where("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    dealt = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = durable(dealt.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    members = durable(dealt.join(shared, "bucket"), "members")
    sets = durable(sets_of(docs, classes.join(members.select("class").distinct(), "class").select("class", "doc_id")), "sets")
    pairs = hub_pairs(members, percent)
    links = durable(confirm(pairs, sets, percent), "links")
    found = components(links)
    label = members.join(found.withColumnRenamed("node", "class"), "class", "left").select("class", "n", "bucket", F.coalesce("component", "class").alias("component"))
    mixed = durable(label.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"), "mixed")
    apart = durable(label.join(mixed, "bucket").select("class", "n", "component").distinct(), "apart")
    more = prefix_pairs(apart.join(sets, "class"), percent)
    last = durable(confirm(more, sets, percent), "links")
    if not last.isEmpty():
        found = merge(found, last)
    forget(shared, members, sets, pairs, links, mixed, apart, more, last)
    return classes, found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...)."""
    signed = durable(signatures(docs, percent), "signatures")
    classes, found = link_classes(docs, signed, percent)
    labelled = durable(classes.select("class", "doc_id").join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "components")
    names = durable(labelled.groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    of_class = durable(labelled.join(names, "component").select("class", "component_id"), "names")
    forget(classes, labelled, names)
    out = signed.select("doc_id", "n_shingles", "class").join(of_class, "class", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` of each group of copies, that of the least id (null last); rows count by id and text, so texts that share an id and rows without one are judged by themselves."""
    row = fresh(docs, "row_")[0]
    key = F.xxhash64("doc_id", "text")
    keyed = docs.select(key.alias("doc_id"), "text")
    signed = durable(signatures(keyed, percent), "signatures")
    classes, found = link_classes(keyed, signed, percent)
    found = found.withColumnRenamed("node", "class")
    forget(classes)
    ids = docs.select(key.alias("key"), F.col("doc_id").alias("id")).groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    rows = signed.where("class is not null").select(F.col("doc_id").alias("key"), "class").distinct().join(found, "class", "left").select("key", F.coalesce("component", "class").alias("component"))
    rows = durable(rows.join(ids, "key"), "rows")
    first = durable(rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select("component", F.col("first.key").alias("first")), "first")
    gone = rows.join(first, "component").where("key <> first").select(F.col("key").alias(row)).distinct()
    left = docs.withColumn(row, key).join(gone, row, "left_anti")
    twice = durable(rows.where("n > 1").select(F.col("key").alias(row)).distinct(), "repeated")
    if not twice.isEmpty():
        left = left.join(twice, row, "left_anti").unionByName(left.join(twice, row, "left_semi").dropDuplicates([row]))
    return left.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
