"""Best-fit packing: bounded-space online best-fit over token sequences.

A packer holds a fixed number of open bins, kept in a bitset keyed by free space: the
lowest set bit at or above a piece's length is the tightest bin. When too many bins
are open, the fullest closes first. Every bucket of documents (a hash of the row, so
a hot source is spread) packs alone; the bins that are still open at its end are
packed again as single items, level by level, so the number of buckets costs nothing.

Defined results: null or empty text is the end id alone; null ids, repeated rows and
extra columns are ordinary (each row is its own document); an empty table gives no
rows; equal choices go by order of arrival, which is a hash of the row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import default_tokenizer, durable, encoder, runs, table

CAPACITY, END_ID = 1024, 2
OPEN_BINS = 1024  # open bins of one packer
BUCKET = 16_384  # documents (or, above the first level, open bins) that one packer takes, about
REMEMBERED = 300_000  # parts of a generation of the encoder
TEXTS = 1 << 21  # bytes of texts encoded at a time
PIECES = "doc_id {id}, row long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Places lengths one after another; ``place`` gives (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.bins = 0

    def _put(self, free: int, b: int) -> None:
        self.by_free[free].append(b)
        self.bits |= 1 << free

    def _take(self, free: int) -> int:
        b = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return b

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = (fitting & -fitting).bit_length() - 1 + length
            b = self._take(free)
        else:
            b, free = self.bins, self.capacity
            self.bins += 1
            self.open += 1
        if free > length:
            self._put(free - length, b)
        else:
            self.open -= 1
        if self.open > self.most:  # the fullest closes
            self._take((self.bits & -self.bits).bit_length() - 1)
            self.open -= 1
        return b, self.capacity - free

    def left(self) -> dict[int, int]:
        """Open bins and their free space."""
        return {b: free for free, own in enumerate(self.by_free) for b in own}


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Begin and end of the pieces of ``n`` ids: all of ``capacity`` but the first, which takes what is over."""
    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
    return list(zip(edges, edges[1:]))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, with its length and the checksum of its ids; ``row`` tells repeated documents apart."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, REMEMBERED), np.uint32(END_ID).tobytes()
        for batch in batches:
            out, at, texts = [], [], batch.column("text")
            for begin, n in runs(texts, TEXTS):
                raw, sizes = enc.encode_all(texts.slice(begin, n), end)
                last = 0
                for k, size in enumerate(sizes.tolist(), begin):
                    ids, last = raw[last : last + size], last + size
                    for i, (a, z) in enumerate(cut(size // 4, capacity)):
                        out.append((i, a, z - a, zlib.crc32(ids[4 * a : 4 * z])))
                        at.append(k)
            found = np.array(out, np.int64).reshape(-1, 4).T
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found[0].astype(np.int32)), *[pa.array(x) for x in found[1:]]], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # workers of a pipeline share their executor's memory with what its earlier stages hold

    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, PIECES.format(id=kind))


def _pack_group(capacity: int, open_bins: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ord", kind="stable")
        packer = Packer(capacity, open_bins)
        placed = [packer.place(int(n)) for n in frame["length"]]
        left = packer.left()
        bins = [b for b, _ in placed]
        return pd.DataFrame({"item": frame["item"].to_numpy(), "bucket": frame["bucket"].to_numpy(), "bin": bins, "offset": [o for _, o in placed], "left": [capacity - left[b] if b in left else 0 for b in bins]})

    return run


def pack_lengths(items: DataFrame, n_items: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, bucket: int = BUCKET) -> DataFrame:
    """items(item struct or id, ord long, length) -> item, sequence_id, offset. ``n_items`` only sets the number of buckets."""
    kind = items.schema["item"].dataType.simpleString()
    n, level, levels = max(1, -(-n_items // bucket)), 0, []
    while True:
        spread = items.withColumn("bucket", F.pmod(F.xxhash64("ord", F.lit(level)), F.lit(n)))
        placed = durable(spread.groupBy("bucket").applyInPandas(_pack_group(capacity, open_bins), f"item {kind}, bucket long, bin long, offset long, left long"), f"packed-{level}")
        levels.append(placed)
        if n == 1:
            break
        rest = placed.where("left > 0").groupBy("bucket", "bin").agg(F.first("left").alias("length"))
        items, kind = rest.select(F.struct("bucket", "bin").alias("item"), F.xxhash64("bucket", "bin").alias("ord"), "length"), "struct<bucket:bigint,bin:bigint>"
        before, n = n, max(1, -(-rest.count() // bucket))
        n, level = min(n, max(1, before // 4)), level + 1
    where = levels[-1].select("item", F.struct(F.lit(len(levels)).alias("level"), "bucket", "bin").alias("seq"), F.col("offset").alias("at"))
    for k in range(len(levels) - 2, -1, -1):
        own = levels[k]
        moved = own.where("left > 0").withColumn("key", F.struct("bucket", "bin")).join(where.withColumnRenamed("item", "key"), "key").select(own["item"], "seq", (F.col("offset") + F.col("at")).alias("at"))
        closed = own.where("left = 0").select("item", F.struct(F.lit(k + 1).alias("level"), "bucket", "bin").alias("seq"), F.col("offset").alias("at"))
        where = closed.unionByName(moved)
    seq = F.col("seq")
    sequence = (seq["level"].cast("long") * F.lit(1 << 58)) + seq["bucket"] * F.lit(1 << 28) + seq["bin"]
    return where.select("item", sequence.alias("sequence_id"), F.col("at").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all documents (doc_id, text, ...)."""
    cut_up = durable(pieces(docs, tokenizer or default_tokenizer(), capacity), "pieces")
    items = cut_up.select(F.struct("doc_id", "row", "piece", "start", "length", "ids_crc32").alias("item"), F.xxhash64("row", "piece").alias("ord"), "length")
    packed = pack_lengths(items, cut_up.count(), capacity, open_bins, bucket)
    return packed.select("item.doc_id", "item.piece", "item.start", "item.length", "item.ids_crc32", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
