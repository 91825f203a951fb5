"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z lower-cased; two
64-bit hashes stand for it. A run is a table (a, b, n) of keys and the documents seen
with each, bucketed and sorted by key, so that two runs merge bucket by bucket without a
shuffle (a full join; their union is not used, as its partitioning is not to be relied
on). A batch is reduced to one row a key, anti-joined with the runs of every level that
hold settled keys (n is at the threshold, so more counting changes nothing) and added as
a run of level 0. A level holds one run: a second one merges with it into the next level,
where counts of a key add up and more keys settle. So a key is rewritten once a level,
and a batch costs its own lines and a merge.

The keys whose total reaches the threshold lose all their lines in all documents. Lines
of a text are kept by position: what goes is looked up by key, gathered by the text's
hash, and taken out of the text where that stands; lines never travel.

Counts are added up before a shuffle, so a line that every document holds is one row a
task. The other joins are on a line's key or a text's hash with one row on the other
side: small by a checked size they are broadcast, else Spark splits hot keys.

Defined results: null and empty texts are one empty line; keys of fewer than
``min_chars`` code points are never dropped; a document counts once for a key however
often it holds the line; repeated rows are documents of their own; ties cannot occur;
very long texts are cut whole; an empty table gives no rows; extra columns stay, those
that are named like a result under another name (underscores in front).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, fresh, make_room, shared_dir, table

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES = 4
SMALL = 1_000_000  # rows and values of a lookup table up to which it is broadcast

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TRIMMED = "trim(both ' \t\n\x0b\f\r' from l)"
_KEY = f"transform(array({_TRIMMED}), k -> if(length(k) = octet_length(k), lower(k), translate(k, '{_UPPER}', '{_UPPER.lower()}')))[0]"


def _lines(text: str) -> str:
    return rf"split(coalesce({text}, ''), '\n')"


def line_keys(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """u, w (hashes of the text), keys: array<struct<a, b>> of its lines in order, null for a line whose key is too short."""
    hashed = f"transform({_lines(text)}, l -> transform(array({_KEY}), k -> if(length(k) >= {min_chars}, struct(xxhash64(k) as a, xxhash64(1, k) as b), null))[0])"
    return docs.select(*_text_hash(text), F.expr(hashed).alias("keys"))


def _text_hash(text: str) -> list:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("u"), F.xxhash64(F.lit(1), whole).alias("w")]


class LineRuns:
    """Runs of line keys, one a level at most. ``add`` takes the keys of a batch of documents, which must be new ones."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))  # as many as a batch's counts have partitions: these are buckets then
        self.folder = f"{shared_dir(spark)}/line-runs-{uuid.uuid4().hex}"
        self.levels: list[str | None] = []

    def _write(self, run: DataFrame) -> str:
        """Bucketed and sorted by key; where ``run`` stands by bucket, a bucket is one file."""
        name = f"line_run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "a", "b").sortBy("a", "b").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        return [name for name in self.levels if name]

    def add(self, keys: DataFrame) -> None:
        """One batch: a column ``keys`` as in ``line_keys``, a row a document."""
        new = keys.select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null").groupBy("k.a", "k.b").agg(F.count("*").alias("n"))
        for name in self.runs():
            new = new.join(self.spark.table(name).where(F.col("n") >= self.min_docs), ["a", "b"], "left_anti")
        run, level = self._write(new), 0
        while level < len(self.levels) and self.levels[level]:  # a level that is taken carries over, as in a binary counter
            run, self.levels[level], level = self._merged(run, self.levels[level]), None, level + 1
        self.levels[level:level + 1] = [run]

    def _merged(self, one: str, two: str) -> str:
        """A run with the keys of both, counts added up: bucket meets bucket in order, nothing is shuffled."""
        x, y = self.spark.table(one), self.spark.table(two).select("a", "b", F.col("n").alias("m"))
        out = self._write(x.join(y, ["a", "b"], "full").select("a", "b", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n")))
        self._drop([one, two])
        return out

    def compacted(self) -> DataFrame | None:
        """a, b, n of all runs, merged into one; None if there are none."""
        runs = self.runs()
        while len(runs) > 1:
            runs = [self._merged(runs[0], runs[1]), *runs[2:]]
        self.levels = [None] * (len(self.levels) - 1) + runs
        return self.spark.table(runs[0]) if runs else None

    def frequent(self) -> DataFrame:
        """a, b of the keys in at least ``min_docs`` documents."""
        found = self.compacted()
        return self.spark.createDataFrame([], "a long, b long") if found is None else found.where(F.col("n") >= self.min_docs).select("a", "b")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        self._drop(self.runs())
        self.levels = []


def _if_small(few: DataFrame, values: Column | None = None) -> DataFrame:
    """``few`` (durable) with a hint to broadcast it if its rows, or the ``values`` in them, are few."""
    size = few.agg(F.count("*") + F.coalesce(F.sum(F.lit(0) if values is None else values), F.lit(0))).first()[0]
    return F.broadcast(few) if size <= SMALL else few


def drop_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text. ``keys``: ``line_keys`` of these texts; ``frequent``: the keys that go (durable)."""
    docs = make_room(docs, "n_lines", "n_dropped", "kept_text")
    lines = keys.select("u", "w", F.posexplode("keys").alias("at", "k")).where("k is not null").select("u", "w", "at", "k.a", "k.b")
    gone = durable(lines.join(_if_small(frequent), ["a", "b"], "left_semi").groupBy("u", "w").agg(F.collect_set("at").alias("gone")), "lines-gone")
    u, w, found = fresh(docs, "u_", "w_", "gone_")
    hits = _if_small(gone, F.size("gone")).withColumnsRenamed({"u": u, "w": w, "gone": found})
    joined = docs.withColumns(dict(zip((u, w), _text_hash(text), strict=True))).join(hits, [u, w], "left")
    left = f"array_join(transform(array({_lines(text)}), x -> transform(array_except(sequence(0, size(x) - 1), {found}), i -> x[i]))[0], '\\n')"
    return joined.withColumns({
        "n_lines": F.expr(f"cast(length(coalesce({text}, '')) - length(replace(coalesce({text}, ''), '\\n', '')) + 1 as bigint)"),
        "n_dropped": F.expr(f"cast(if({found} is null, 0, size({found})) as bigint)"),
        "kept_text": F.expr(f"if({found} is null, coalesce({text}, ''), {left})"),
    }).drop(u, w, found)


def dedup(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: lines of keys in ``min_docs`` documents or more are gone everywhere. Rows come in as ``batches``."""
    spark = docs.sparkSession
    keys = durable(line_keys(docs, text, min_chars), "line-keys")
    store = LineRuns(spark, min_docs)
    for k in range(batches):
        store.add(keys.where(F.pmod("w", F.lit(batches)) == k))
    frequent = durable(store.frequent(), "frequent-lines")
    store.close()
    return drop_lines(docs, keys, frequent, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select row, unnest(lines) as line, unnest(range(len(lines))) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct row) >= 10),
g as (select k.*, f.key is not null as gone from k left join f using (key)),
r as (select row, count(*) as n_lines, count(*) filter (where gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as kept from g group by row)
select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from d join r using (row)
"""
