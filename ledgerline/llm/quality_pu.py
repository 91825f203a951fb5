"""Quality classifier: positive-unlabelled learning by the non-negative risk.

Trusted positives are labelled documents of the learning folds; unlabelled text is a
hash sample of all documents of those folds. A small network over rates of the whole
text minimises  prior * R_P(+) + max(0, R_U(-) - prior * R_P(-)): when the second part
turns negative its gradient is taken back, so the flexible model cannot explain the
unlabelled positives away. The class prior comes first, and from the same two samples,
so labels of 0 are not used anywhere: a plain positive-against-unlabelled network,
trained on half of the documents, ranks the other half, and the least ratio of the
shares of both samples above a threshold is what positives make up of the unlabelled
rows; the two halves take turns.

Fitting sees at most about ``textstats.SAMPLE`` positives and as many unlabelled rows;
scoring is one pass. Labels, lang, source and doc_id are never inputs of a score.

Defined results: null or empty text has rates of 0 and is scored like any other; a
repeated row is scored alike; with no trusted positive the score is the prior 0.5;
null doc_id is not held out; an empty table gives no rows; extra columns stay, those
named score or predicted under another name (underscores in front).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, make_room, table
from .textstats import RATES, SAMPLE, labelled, rates, remainder, with_counts

HIDDEN, STEPS, RATE, DECAY = 12, 400, 0.03, 1e-4
LEAST = 0.3  # of the positives: smaller shares are too noisy to read the prior off


def shape(x: np.ndarray) -> np.ndarray:
    """Rates on a scale on which small ones differ, with the number of words as a logarithm."""
    x = np.asarray(x, np.float64).copy()
    x[:, -1] = np.log1p(x[:, -1])
    tail = np.log1p(200 * np.abs(x[:, :-1]))
    return np.hstack([np.clip(x, -50, 50), np.minimum(tail, 8)])


class Network:
    def __init__(self, n: int, seed: int = 7):
        r = np.random.default_rng(seed)
        self.w = [r.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m = [np.zeros_like(w) for w in self.w]
        self.v = [np.zeros_like(w) for w in self.w]
        self.t = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.w[0] + self.w[1])
        return h, h @ self.w[2] + self.w[3][0]

    def backward(self, x: np.ndarray, h: np.ndarray, d: np.ndarray) -> None:
        """An Adam step on the gradient of the outputs."""
        dh = np.outer(d, self.w[2]) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(0), h.T @ d, np.array([d.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            g = g + DECAY * self.w[i]
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.w[i] = self.w[i] - RATE * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(p: np.ndarray, u: np.ndarray, prior: float | None) -> Network:
    """With a prior the non-negative risk, else plain positives against unlabelled rows; logistic loss."""
    net, x, n = Network(p.shape[1]), np.vstack([p, u]), len(p)
    for _ in range(STEPS):
        h, f = net.forward(x)
        s = sigmoid(f)
        d = np.zeros(len(x))
        if prior is None:
            d[:n], d[n:] = 0.5 * (s[:n] - 1) / n, 0.5 * s[n:] / len(u)
        else:
            loss_minus = np.logaddexp(0, f)
            negative = loss_minus[n:].mean() - prior * loss_minus[:n].mean()
            d[:n], d[n:] = -prior * s[:n] / n, s[n:] / len(u)
            if negative >= 0:
                d[:n] += prior * (s[:n] - 1) / n
            else:  # undo the step beyond zero
                d = -d
        net.backward(x, h, d)
    return net


def least_ratio(p: np.ndarray, u: np.ndarray) -> float:
    """Least ratio of the unlabelled to the positive share above a score that LEAST of the positives or more reach."""
    p, u = np.sort(p), np.sort(u)
    c = np.unique(p[: len(p) - int(np.ceil(LEAST * len(p))) + 1])
    above = lambda x: 1 - np.searchsorted(x, c, "left") / len(x)
    return float((above(u) / above(p)).min())


def estimate_prior(p: np.ndarray, u: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray) -> float:
    """Share of positives among the unlabelled rows; folds (0 or 1) keep a document's rows in one half."""
    found = []
    for k in (0, 1):
        if min((fold_p == k).sum(), (fold_p != k).sum(), (fold_u == k).sum(), (fold_u != k).sum()) < 20:
            return 0.5  # too few to tell
        net = train(p[fold_p != k], u[fold_u != k], None)
        found.append(least_ratio(net.forward(p[fold_p == k])[1], net.forward(u[fold_u == k])[1]))
    return float(np.clip(np.mean(found), 0.02, 0.98))


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray, fold_p: np.ndarray, fold_u: np.ndarray, prior: float | None = None):
        self.net = None
        if len(p) and len(u):
            p, u = shape(p), shape(u)
            both = np.vstack([p, u])
            self.mean, self.std = both.mean(0), both.std(0) + 1e-9
            p, u = (p - self.mean) / self.std, (u - self.mean) / self.std
            self.prior = estimate_prior(p, u, fold_p, fold_u) if prior is None else prior
            self.net = train(p, u, self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(x), 0.5)
        return sigmoid(self.net.forward((shape(x) - self.mean) / self.std)[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, left_out: int = 1, bound: int = SAMPLE) -> Model:
    """Positives: labelled quality 1; unlabelled: any documents; both from folds other than ``left_out``."""
    learn = remainder(F.col("doc_id"), modulus) != left_out
    trusted = labelled(labels.where("quality = 1"), "quality", learn, bound)
    own = docs.select("doc_id", "text").where(learn)
    n = own.count()
    some = own if n <= bound else own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
    both = own.join(F.broadcast(trusted.select("doc_id")), "doc_id").withColumn("trusted", F.lit(True)).unionByName(some.withColumn("trusted", F.lit(False)))
    rows = with_counts(both).select("trusted", "doc_id", *[c.alias(k) for k, c in rates().items()]).orderBy("trusted", "doc_id").collect()
    part = lambda kind: np.array([[r[f] for f in RATES] for r in rows if r["trusted"] is kind]).reshape(-1, len(RATES))
    fold = lambda kind: np.array([zlib.crc32(f"half {r['doc_id']}".encode()) % 2 for r in rows if r["trusted"] is kind], np.int64)
    return Model(part(True), part(False), fold(True), fold(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(model.score(x.to_numpy()))

    docs = make_room(docs, "score", "predicted")
    counts = fresh(docs, "counts")[0]
    out = with_counts(docs, counts).withColumn("score", run(F.struct(*[c.alias(k) for k, c in rates(counts).items()])))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop(counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
