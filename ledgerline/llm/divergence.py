"""Source divergence audit: which sources of a language differ most, and in which terms.

Plain relational: regular expression matches of every text are exploded and counted by
(lang, source, term); the terms in at least MIN_DOCS documents of a language are kept;
the groups of a language are crossed with its kept terms so that a term a group never
uses has its count of 0; the dense table joins itself on lang and term, the differences
are summed for each pair of groups, and windows rank them.

The matches of PART bytes of texts are counted where they are found, as sorted numbers of
(term, document), so a task emits sums and not words. These meet by (lang, term) in one
shuffle, which serves the sums of a group, those of the language (a window over the rows
of a term) and the choice of kept terms. Counts are integers, probabilities integers of
SCALE, so sums do not depend on order. From the kept terms on, a number stands for each
(lang, term) and each (lang, source); the keys of the large shuffles hold a term, whose
rows are one for each group of the language. Groups meet the
kept terms of their language by broadcast while there are at most SMALL groups, else by
(lang, salt) with the groups repeated for each salt. A pair is summed once and read
from both sides, as its value is symmetric.

Defined results: null text, lang and source are empty strings, which form groups of
their own; only A-Z are lower-cased; repeated rows count as documents of their own;
groups without terms, and languages without kept terms (value 0), take part; equal
values are ranked by the item in the order of UTF-8 bytes; very long texts are read
whole, match by match; an empty table gives no rows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, forget, table

MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")  # over UTF-8 bytes: those from 0x80 on belong to characters that are not ASCII
BLANKED = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(256))  # A-Z lower-cased, what is in no term blank
LONG = 1 << 20  # bytes of a text from which its matches are not listed
PART = 1 << 24  # bytes of texts whose matches are counted together
SMALL, SALTS = 50_000, 256
COUNTS = ["lang", "source", "term", "n", "d"]


def _split(text: pa.Array) -> pa.Array:
    """The lower-cased matches of each text (large_binary), as lists; some are empty."""
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    blanked = text.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes().translate(BLANKED)
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(text), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(blanked)]))


def _counted(text: pa.Array, lang: np.ndarray, source: np.ndarray) -> Iterator[pa.RecordBatch]:
    groups = {g: k for k, g in enumerate(sorted(set(zip(lang, source))))}
    own = np.array([groups[g] for g in zip(lang, source)])
    order = np.argsort(own, kind="stable")  # documents of a group stand together
    group, place = own[order], np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists = _split(text)
    found, at = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    there = pc.binary_length(found).to_numpy() > 0
    if not there.all():
        found, at = found.filter(pa.array(there)), at[there]
    if not len(found):
        return
    found = found.dictionary_encode()
    key = found.indices.to_numpy().astype(np.int64) * len(order)
    key += place[at]
    terms = found.dictionary
    del found, lists, at, there  # what is large goes when it has been read
    key.sort()
    term, at = np.divmod(key, len(order))
    group = group[at]
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (group[1:] != group[:-1])])
    d = np.add.reduceat(np.r_[True, key[1:] != key[:-1]].astype(np.int64), starts)
    lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(group[starts])) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([lang, source, terms.take(pa.array(term[starts])).cast(pa.string()), pa.array(np.diff(np.r_[starts, len(key)])), pa.array(d)], COUNTS)


def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n (occurrences), d (documents), summed over PART bytes of texts, or over a LONG text."""
    for batch in batches:
        text, lang, source = (batch.column(c) for c in ("text", "lang", "source"))
        text, lang, source = text.cast(pa.large_binary()), np.array(lang.to_pylist(), object), np.array(source.to_pylist(), object)
        size = pc.binary_length(text).to_numpy()
        for k in np.flatnonzero(size >= LONG):
            if own := Counter(m[0] for m in TERM.finditer(text[k].as_py().lower())):  # of bytes: A-Z alone
                yield pa.RecordBatch.from_arrays([pa.repeat(lang[k], len(own)), pa.repeat(source[k], len(own)), pa.array(list(own), pa.binary()).cast(pa.string()), pa.array(list(own.values()), pa.int64()), pa.repeat(1, len(own)).cast(pa.int64())], COUNTS)
        short = np.flatnonzero(size < LONG)
        for k in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // PART)) + 1):
            if len(k):
                yield from _counted(text.take(pa.array(k)), lang[k], source[k])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents); all rows of a (lang, term) are in one partition."""
    rows = docs.select(F.col("text").cast("binary").alias("text"), "lang", "source").mapInArrow(matches, "lang string, source string, term string, n long, d long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _scaled(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact for any counts."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(19,0))) div cast({total} + 2 * {kept} as decimal(19,0))")


_DIFFERENCE = "((p - q) * (p - q)) div (p + q)"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of all ``docs`` (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = durable(docs.select("lang", "source").distinct().withColumn("g", F.monotonically_increasing_id()), "term-groups")
    w = Window.partitionBy("lang", "term")
    counts = term_counts(docs).join(groups, ["lang", "source"]).withColumn("id", F.monotonically_increasing_id())
    counts = counts.withColumns({"t": F.min("id").over(w), "n_lang": F.sum("n").over(w), "d_lang": F.sum("d").over(w)}).where(F.col("d_lang") >= min_docs)
    kept = durable(counts.select("t", "g", "n", "lang", "term", "n_lang", (F.col("id") == F.col("t")).alias("first")), "kept-counts")
    terms = kept.where("first").select("lang", "term", "n_lang", "t")
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    sizes = groups.join(kept.groupBy("g").agg(F.sum("n").alias("total")), "g", "left").join(langs, "lang", "left")
    sizes = durable(sizes.fillna(0, ["total", "v", "total_lang"]), "group-sizes")
    out = durable(_pairs(sizes, terms, kept).unionByName(_terms(sizes, kept, top)), "divergence")
    forget(groups, kept, sizes)
    return out


def _dense(sizes: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    """t, g, p for each group and each kept term of its language."""
    sizes = sizes.select("lang", "g", "total", "v")
    if sizes.count() <= SMALL:
        crossed = terms.select("lang", "t").join(F.broadcast(sizes), "lang")
    else:
        salted = terms.select("lang", "t", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int").alias("salt"))
        crossed = salted.join(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["lang", "salt"])
    filled = kept.select("t", "g", "n").unionByName(crossed.select("t", "g", F.lit(0).cast("long").alias("n"))).repartition("t").groupBy("t", "g").agg(F.sum("n").alias("n"))
    return filled.join(sizes.select("g", "total", "v"), "g").select("t", "g", _scaled("n", "total", "v").alias("p"))


def _pairs(sizes: DataFrame, terms: DataFrame, kept: DataFrame) -> DataFrame:
    dense = _dense(sizes, terms, kept)
    other = dense.select("t", F.col("g").alias("h"), F.col("p").alias("q"))
    met = dense.join(other, "t").where("g < h").groupBy("g", "h").agg(F.expr(f"sum({_DIFFERENCE})").alias("value"))
    silent = sizes.where("v = 0").select("lang", "g")  # languages without kept terms
    met = met.unionByName(silent.join(silent.withColumnRenamed("g", "h"), "lang").where("g < h").select("g", "h", F.lit(0).cast("long").alias("value")))
    both = met.select("value", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x")).select("x.*", "value")
    named = both.join(sizes.select("g", "lang", "source"), "g").join(sizes.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    return _ranked(named, "pair")


def _terms(sizes: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    x = kept.select("g", "n", "term", "n_lang").join(sizes, "g").select("lang", "source", F.col("term").alias("item"), _scaled("n", "total", "v").alias("p"), _scaled("n_lang", "total_lang", "v").alias("q"))
    return _ranked(x.where("p > q").select("lang", "source", "item", F.expr(_DIFFERENCE).alias("value")), "term").where(F.col("rank") <= top)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    return values.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
with d as (select row_number() over () as row, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
t as (select row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
v as (select lang, term, count(*) as nl from t group by all having count(distinct row) >= 10),
c as (select lang, source, term, count(*) as n from t semi join v using (lang, term) group by all),
l as (select lang, count(*) as v, sum(nl) as tl from v group by lang),
s as (select g.lang, g.source, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0) as total, coalesce(l.v, 0) as v, coalesce(l.tl, 0) as tl from (select distinct lang, source from d) g left join l using (lang)),
p as (select s.lang, s.source, v.term, coalesce(c.n, 0) as n, cast(1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (s.total + 2 * s.v) as hugeint) as p,
  cast(1 + (1000000000::hugeint * (v.nl + 2)) // (s.tl + 2 * s.v) as hugeint) as q from s join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = v.term),
pair as (select a.lang, a.source, b.source as item, coalesce((select sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) from p x join p y on x.term = y.term where x.lang = a.lang and y.lang = a.lang and x.source = a.source and y.source = b.source), 0) as value
  from s a join s b on a.lang = b.lang and a.source <> b.source),
term as (select lang, source, term as item, (p - q) * (p - q) // (p + q) as value from p where n > 0 and p > q),
r as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as rank from pair
  union all (select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, encode(item)) as k from term qualify k <= 10))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r
"""
