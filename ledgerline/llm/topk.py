"""Exact top-k search: exhaustive term-at-a-time accumulation.

Components become integers, terms are positions. Queries come in blocks of about
QUERIES, each broadcast to the candidates, which stay where they are: a batch of them is
turned into postings (for each term the rows and weights that are not 0) once, each term
of the queries adds its weighted postings to dense score arrays, a few queries at a
time, and a partition selection keeps k. A task carries the best k of its batches, so
a ranked merge gets k rows for each query and task.

Defined results: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without an id; rows that repeat an id are candidates and
queries of their own (a query leaves out its own row alone); missing trailing
components count as 0; equal scores go to the smaller id; no candidates give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, shared_dir, table

K, SCALE, EVERY = 5, 256, 50
QUERIES = 4_096  # queries of a block, about; what is broadcast
AT_ONCE = 64  # queries whose dense score arrays are held together


def integers(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, row (tells repeated ids apart), v array<long>: floor(scale * component)."""
    x = F.col(vector)
    whole = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return vectors.where(F.col(id_column).isNotNull() & whole).select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), ints.alias("v"))


def _dense(rows) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def postings(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows whose weight is not 0, and these weights."""
    return [(rows, c[rows, term]) for term in range(c.shape[1]) for rows in [np.flatnonzero(c[:, term])]]


def accumulate(q: np.ndarray, posts: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of every query against each of ``n`` candidates."""
    scores = np.zeros((len(q), n), np.int64)
    for term, (rows, weights) in enumerate(posts[: q.shape[1]]):
        asking = np.flatnonzero(q[:, term])
        if len(rows) == n:
            for i in asking:
                scores[i] += q[i, term] * weights
        else:
            for i in asking:
                scores[i, rows] += q[i, term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id, without the query's own row; ids ascend."""
    if len(ids) <= k + 1:
        at = np.arange(len(ids))
    else:
        edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
        above, equal = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
        at = np.concatenate([above, equal[: k + 1]])
    at = at[~own[at]]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _meet(shared, k: int):
    def run(batches):
        ids, rows, q = shared.value
        kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)  # scores, ids
        for batch in batches:
            batch = batch.sort_values("id", kind="stable")
            cid, crow, posts = batch["id"].to_numpy(), batch["row"].to_numpy(), postings(_dense(batch["v"].to_list()))
            for a in range(0, len(q), AT_ONCE):
                for i, s in enumerate(accumulate(q[a : a + AT_ONCE], posts, len(cid)), a):
                    at = best(s, cid, crow == rows[i], k)
                    s, c = np.concatenate([kept[i][0], s[at]]), np.concatenate([kept[i][1], cid[at]])
                    order = np.lexsort((c, -s))[:k]
                    kept[i] = (s[order], c[order])
        n = [len(c) for _, c in kept]
        if sum(n):
            yield pd.DataFrame({"query_id": np.repeat(ids, n), "query_row": np.repeat(rows, n), "vec_id": np.concatenate([c for _, c in kept]), "score": np.concatenate([s for s, _ in kept])})

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K, block: int = QUERIES) -> DataFrame:
    """queries and candidates (id, row, v) -> query_id, rank, vec_id, score."""
    spark, path = queries.sparkSession, f"{shared_dir(queries.sparkSession)}/topk-{uuid.uuid4().hex}"
    n = max(1, -(-queries.count() // block))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    for b in range(n):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b).select("id", "row", "v").collect()
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in own], np.int64), np.array([r["row"] for r in own], np.int64), _dense([r["v"] for r in own])))
        met = candidates.select("id", "row", "v").mapInPandas(_meet(shared, k), "query_id long, query_row long, vec_id long, score long")
        met.withColumn("rank", rank.cast("int")).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = durable(integers(table(spark, sf_dir, "embeddings")), "vectors")
    return search(vectors.where(F.pmod("id", F.lit(EVERY)) == 0), vectors)


ORACLE = """
with v as (select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, q.row, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from v q join v c on c.row <> q.row where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by row order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 5
"""
