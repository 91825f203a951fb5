"""Token-id output: a content-addressed store of id streams.

Files, all Parquet, below one folder:

* ``packs``: a row for each unique chunk (``digest``, ``n``, ``data``: its ids,
  little-endian, 2 bytes each if the vocabulary allows, else 4), and beside them the
  recipes as the tasks left them (``digest`` is null), which only ``recipes`` is made of.
* ``recipes``: a row for each document in ascending ``doc_id``: the sizes and digests of
  its chunks in order and the Merkle root over the digests; ``part`` is the file's place
  in the order, ``idx`` the document's place in it, ``at`` the ids before it there.
* ``manifest``: for each part, the number of documents and ids and the Merkle root
  over its documents' roots, by blocks of FAN.

Chunks are cut where a rolling hash over the last ids has its low bits clear, so the
cuts follow content: copies share all chunks, near copies most. A task stores a chunk
it meets again only once, so the shuffle that settles who keeps the bytes gets at most
one row for each task and digest. Reading checks every chunk against its digest, every
recipe against its root and its number of ids, and the manifest against the recipes;
what does not agree raises.

Defined results: null or empty text is the end id alone; null ``doc_id`` comes first;
repeated rows are documents of their own; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Encoder, default_tokenizer, encoder, release, runs, shared_dir, table

END_ID = 2
WINDOW, MASK, LEAST, MOST = 8, 255, 64, 1024  # ids hashed together; cut where hash & MASK is 0; ids in a chunk
SEEN = 200_000  # digests that a task remembers
AT_ONCE = 256  # documents whose ids are hashed together
FAN = 1024  # roots below one node of a part's tree


@lru_cache(1)
def gear(size: int = 1 << 17) -> np.ndarray:
    x = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places behind which the content allows a cut. A cut leaves LEAST ids, more than WINDOW, so streams that lie behind one another do not disturb each other."""
    g = gear()[ids & np.uint32((1 << 17) - 1)]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint32(k)
    return np.flatnonzero((h >> np.uint32(WINDOW)) & np.uint32(MASK) == 0) + 1


def cuts(n: int, marked: list[int]) -> list[int]:
    """Ends of the chunks of ``n`` ids."""
    if n <= LEAST:
        return [n]
    out, last = [], 0
    for at in marked:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST and at < n:
            out.append(at)
            last = at
    while n - last > MOST:
        last += MOST
        out.append(last)
    return [*out, n]


def digest(data: bytes | memoryview) -> bytes:
    """Of ids as little-endian unsigned 32-bit integers."""
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    while len(leaves) > 1:
        leaves = [digest(b"".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
    return leaves[0]


def unpack(data: pa.Array, n: int) -> np.ndarray:
    """The ids of a column of packed chunks, ``n`` in all."""
    raw = b"".join(data.to_pylist())
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


POLY = np.uint32(0xEDB88320)


def crc_times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the checksum's, elementwise."""
    p, b = np.zeros_like(b), b.copy()
    for bit in range(31, -1, -1):
        p ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), POLY, np.uint32(0))
    return p


_shifts = [np.array([1 << 31, 1 << 30], np.uint32)]


def crc_shifts(most: int) -> np.ndarray:
    """x to the power 32 n for n = 0 ... most at least: what n ids put behind a checksum."""
    found = _shifts[0]
    if len(found) == 2:  # so far x to the powers 0 and 1
        step = found[1:]
        for _ in range(5):
            step = crc_times(step, step)
        found = np.concatenate([found[:1], step])
    while len(found) <= most:
        ahead = crc_times(found[-1:], found[1:2])  # x to the power 32 len(found)
        found = np.concatenate([found, crc_times(np.repeat(ahead, len(found)), found)])
    _shifts[0] = found
    return found


def _lists(counts: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def streams(enc: Encoder, texts: pa.Array, end: bytes) -> Iterator[tuple[int, memoryview, list[int]]]:
    """Place of the first, ids and numbers of ids of at most AT_ONCE texts."""
    for begin, n in runs(texts):
        raw, sizes = enc.encode_all(texts.slice(begin, n), end)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for a in range(0, n, AT_ONCE):
            z = min(a + AT_ONCE, n)
            yield begin + a, raw[ends[a] : ends[z]], (sizes[a:z] // 4).tolist()


_PACKS = "row long, n_tokens long, root binary, sizes array<int>, digests array<binary>, digest binary, n int, data binary"


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None) -> None:
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, seen = encoder(path), np.uint32(END_ID).tobytes(), set()
        narrow = "<u2" if enc.tok.get_vocab_size() <= 1 << 16 else "<u4"
        for batch in batches:
            for a, raw, lengths in streams(enc, batch.column("text"), end):
                ids = np.frombuffer(raw, "<u4")
                wide, packed, width = raw, memoryview(ids.astype(narrow).tobytes()), np.dtype(narrow).itemsize
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                places = marks(ids)
                edges = np.searchsorted(places, bounds, "right").tolist()
                sizes, digests, counts, roots, fresh, data = [], [], [], [], [], []
                for k, (begin, n) in enumerate(zip(bounds.tolist(), lengths)):
                    own, last = [], 0
                    for at in cuts(n, (places[edges[k] : edges[k + 1]] - begin).tolist() if n > LEAST else []):
                        key = digest(wide[4 * (begin + last) : 4 * (begin + at)])
                        own.append(key)
                        sizes.append(at - last)
                        if key not in seen:
                            if len(seen) < SEEN:
                                seen.add(key)
                            fresh.append((key, at - last))
                            data.append(packed[width * (begin + last) : width * (begin + at)])
                        last = at
                    digests += own
                    counts.append(len(own))
                    roots.append(merkle(own))
                few, more = len(lengths), len(fresh)
                none = lambda t, n=more: pa.nulls(n, t)
                doc, row = batch.column("doc_id").slice(a, few), batch.column("row").slice(a, few)
                recipes = [doc, row, pa.array(lengths, pa.int64()), pa.array(roots, pa.binary()), _lists(counts, pa.array(sizes, pa.int32())), _lists(counts, pa.array(digests, pa.binary())), none(pa.binary(), few), none(pa.int32(), few), none(pa.binary(), few)]
                names = ["doc_id", "row", "n_tokens", "root", "sizes", "digests", "digest", "n", "data"]
                yield pa.RecordBatch.from_arrays(recipes, names)
                chunks = [pa.array([f[0] for f in fresh], pa.binary()), pa.array([f[1] for f in fresh], pa.int32()), pa.array(list(map(bytes, data)), pa.binary())]
                yield pa.RecordBatch.from_arrays([none(x.type) for x in recipes[:6]] + chunks, names)

    stream = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(run, f"doc_id {kind}, {_PACKS}")
    so_far = F.count("*").over(Window.partitionBy("digest", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))  # rows of a recipe are all different; a rank would be sorted on both sides of the shuffle
    stream.withColumn("so_far", so_far).where("so_far = 1").drop("so_far").write.option("compression", "zstd").parquet(f"{folder}/packs")
    spark = docs.sparkSession

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the encoder's memory is not asked for any more
        idx = at = 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            before = at + np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(idx, idx + len(n))), pa.array(before[:-1].astype(np.int64))], [*b.schema.names, "idx", "at"])
            idx, at = idx + len(n), int(before[-1])

    recipes = spark.read.parquet(f"{folder}/packs").where("digest is null").select("doc_id", "row", "n_tokens", "root", "sizes", "digests")
    recipes = recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    recipes.mapInArrow(number, f"doc_id {kind}, row long, n_tokens long, root binary, sizes array<int>, digests array<binary>, part int, idx long, at long").write.parquet(f"{folder}/recipes")
    manifest(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """Documents, ids and the root over the recipes of each part, FAN of them at a time, level by level. A leaf covers place, id, lengths and digests of a recipe."""
    total = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    most = total.agg(F.max("n_docs")).first()[0] or 1
    leaf = F.concat_ws(":", "idx", "at", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "n_tokens", F.array_join("sizes", ","), F.hex("root"))
    level = recipes.select("part", "idx", F.sha2(leaf, 256).alias("root"))
    while True:
        pair = F.sort_array(F.collect_list(F.struct("idx", "root")))  # at most FAN
        level = level.withColumn("block", F.floor(F.col("idx") / FAN)).groupBy("part", "block").agg(pair.alias("p")).select("part", F.col("block").alias("idx"), F.sha2(F.array_join(F.transform("p", lambda x: x["root"]), ""), 256).alias("root"))
        most = -(-most // FAN)
        if most <= 1:
            return total.join(level.drop("idx"), "part")


def _with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Recipes with ``start``: ids of the parts before (a row for each part) and of the documents before within the part."""
    parts = spark.read.parquet(f"{folder}/manifest")
    before = parts.select("part", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return spark.read.parquet(f"{folder}/recipes").join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at")).drop("before", "part", "idx", "at")


def _or_raise(holds: Column, value: Column, what: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.lit(what)).cast("long"))


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files: every stored chunk is read and hashed again, and the checksums of a
    document's chunks, each moved by the ids behind it, add up to the document's. Raises where digest, root or length disagree."""

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            n = b.column("n").to_numpy()
            raw, ends = memoryview(unpack(b.column("data"), int(n.sum())).tobytes()), (4 * np.cumsum(n)).tolist()
            parts = [raw[a:z] for a, z in zip([0, *ends], ends)]
            if list(map(digest, parts)) != b.column("digest").to_pylist():
                raise ValueError("a stored chunk does not match its digest")
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), pa.array(list(map(zlib.crc32, parts)), pa.int64())], ["digest", "n", "crc"])

    def references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            own = b.column("digests").to_pylist()
            if list(map(merkle, own)) != b.column("root").to_pylist():
                raise ValueError("a recipe does not match its root")
            sizes, counts = b.column("sizes").flatten().to_numpy(), np.array(list(map(len, own)), np.int64)
            at = np.repeat(np.arange(len(own)), counts)
            total, n = np.cumsum(sizes), b.column("n_tokens").to_numpy()
            begin = total[np.concatenate([[0], np.cumsum(counts)[:-1]])] - sizes[np.concatenate([[0], np.cumsum(counts)[:-1]])] if len(own) else total
            behind = (np.repeat(n + begin, counts) - total).astype(np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in ("doc_id", "row", "start", "n_tokens")] + [pa.array(sizes, pa.int32()), b.column("digests").flatten(), pa.array(crc_shifts(int(behind.max(initial=0)))[np.maximum(behind, 0)].astype(np.int64))], ["doc_id", "row", "start", "n_tokens", "n", "digest", "shift"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = crc_times(b.column("shift").to_numpy().astype(np.uint32), b.column("crc").to_numpy().astype(np.uint32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(x)], [*b.schema.names[:5], "x"])

    chunks = spark.read.parquet(f"{folder}/packs").where("digest is not null").select("digest", "n", "data").mapInArrow(chunk, "digest binary, n int, crc long")
    whole = _with_starts(spark, folder).select("doc_id", "row", "start", "n_tokens", "root", "sizes", "digests")
    own = f"doc_id {whole.schema['doc_id'].dataType.simpleString()}, row long, start long, n_tokens long, n int"
    refs = whole.mapInArrow(references, f"{own}, digest binary, shift long")
    here = F.col("crc").isNotNull()  # a chunk that is not there, or of another length, counts as no ids
    met = refs.join(chunks, ["digest", "n"], "left").withColumns({"n": F.when(here, F.col("n")).otherwise(0), "crc": F.coalesce("crc", F.lit(0))})
    moved = met.select("doc_id", "row", "start", "n_tokens", "n", "shift", "crc").mapInArrow(move, f"{own}, x long")
    out = moved.groupBy("doc_id", "row", "start", "n_tokens").agg(F.bit_xor("x").alias("ids_crc32"), F.sum("n").alias("n"))
    return out.select("doc_id", "start", "n_tokens", _or_raise(F.col("n") == F.col("n_tokens"), F.col("ids_crc32"), "a document's chunks are not all there").alias("ids_crc32"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids array of every document, put together from the store."""

    @F.pandas_udf("array<long>")
    def join(chunks):
        return chunks.map(lambda x: np.concatenate([unpack(pa.array([c["data"]], pa.binary()), c["n"]) for c in x]).astype(np.int64).tolist())

    data = spark.read.parquet(f"{folder}/packs").where("digest is not null").select("digest", "n", "data")
    refs = _with_starts(spark, folder).select("doc_id", "row", "start", F.posexplode("digests").alias("seq", "digest"))
    whole = refs.join(data, "digest").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("seq", "n", "data"))).alias("c"))
    return whole.select("doc_id", "start", join("c").alias("ids"))


def verify_manifest(spark: SparkSession, folder: str) -> bool:
    """Whether the parts' counts and roots follow from the recipes."""
    kept, found = spark.read.parquet(f"{folder}/manifest"), manifest(spark.read.parquet(f"{folder}/recipes"))
    both = kept.select("part", F.struct("n_docs", "n_ids", "root").alias("kept")).join(found.select("part", F.struct("n_docs", "n_ids", "root").alias("found")), "part", "full")
    return both.where(~F.col("kept").eqNullSafe(F.col("found"))).isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), folder)
    if not verify_manifest(spark, folder):
        raise ValueError("the manifest does not match the recipes")
    return read_summary(spark, folder)
