"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: density of a fixed list of insults, density and mean weight
of a lexicon learned from the labels, insults near a second-person word, second-person
words, capitals, punctuation and shouting, and obfuscated spellings (figures or signs
inside words, and words that turn into insults when those are read as letters).

The model is fitted on at most about ``textstats.SAMPLE`` labelled rows of the learning
folds, which bounds the lexicon, too. Their texts are dealt to FOLDS parts by hash, so that
copies stay together. A row's features come from the lexicon of the other parts, and the
scores that calibrate it (pooled adjacent violators, read with linear interpolation) from
trees of the other parts as well: no row has shaped its own features or its own score.
Documents are scored by the lexicon and the trees of all parts.

Defined results: null or empty text has features of 0; a repeated row is scored alike;
without labelled rows of both kinds the score is the share of toxic rows (0 if none);
null doc_id is not held out; an empty table gives no rows; extra columns stay, those
named score or predicted under another name (underscores in front).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import make_room, table
from .textstats import SAMPLE, labelled, remainder

# Common insults in the four languages.
INSULTS = frozenset("""
idiot idiots idiotic moron morons moronic stupid dumb dumbass trash garbage scum loser losers pathetic worthless disgusting clown clowns
filth vermin imbecile cretin scumbag bastard bitch asshole jerk retard retarded freak hateful ugly fool
idiotin dumm dummkopf abschaum arschloch trottel depp versager drecksack blödmann widerlich erbärmlich müll
idiote imbécile crétin connard connasse salaud ordure débile minable racaille abruti pauvre-type dégoûtant
idiota imbécil estúpido estúpida tonto basura escoria payaso perdedor patético asqueroso cabrón gilipollas
""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tuyo vuestra".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
MIXED = re.compile(r"(?<!\S)[^\W\d_]+[0-9@$*!|][\w@$*!|]*[^\W\d_]")
SUPPORT = 8  # documents a learned word needs at least
FOLDS = 3  # parts of the labelled texts
NEAR = 5  # words between an insult and a second-person word
TREES, DEPTH, SHRINK, BINS, LEAF = 80, 3, 0.15, 64, 12
FEATURES = ("insults", "insult_count", "learned", "learned_weight", "second_near", "second", "capitals", "shouts", "marks", "mixed", "unmasked")


def features(text: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    words = WORD.findall(text.lower())
    if not words:
        return (0.0,) * len(FEATURES)
    n = len(words)
    hits = [i for i, w in enumerate(words) if w in INSULTS or w in lexicon]
    own = sum(words[i] in INSULTS for i in hits)
    weight = sum(lexicon.get(words[i], 0.0) for i in hits)
    second = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits) if second else 0
    mixed = MIXED.findall(text)
    unmasked = sum(1 for w in mixed if (t := WORD.findall(w.lower().translate(LEET))) and any(x in INSULTS or x in lexicon for x in t))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    shouts = text.count("!") + text.count("?")
    marks = sum(map(text.count, "#*$%&|<>"))
    return (math.log1p(1000 * own / n), float(own), math.log1p(1000 * (len(hits) - own) / n), weight, near / n, second / n, upper / len(text), shouts / n, marks / n, len(mixed) / n, float(unmasked))


def learn_lexicons(rows: DataFrame) -> list[dict[str, float]]:
    """Words whose documents are mostly toxic, by the lower end of a 95 % interval, with their weight: without each part, then of all."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(w, y, hash_of(t), k) for t, y, k in zip(b["text"], b["label"], b["fold"]) for w in set(WORD.findall((t or "").lower()))]
            yield pd.DataFrame(found, columns=["word", "label", "own", "fold"])

    def hash_of(text: str | None) -> int:
        return int.from_bytes(hashlib.blake2b((text or "").encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)  # copies count once

    own = rows.select("text", "label", fold_of("text").alias("fold"))
    count = lambda c, k: F.sum(F.when(F.col("fold") != k, c)) if k < FOLDS else F.sum(c)
    words_of = own.mapInPandas(words, "word string, label int, own long, fold int").distinct().groupBy("word").agg(*[count(c, k).alias(f"{name}{k}") for k in range(FOLDS + 1) for name, c in (("a", F.col("label")), ("n", F.lit(1)))])
    low = lambda k: F.when(F.col(f"a{k}") >= SUPPORT, lower_end(F.col(f"a{k}"), F.col(f"n{k}")))
    top = words_of.select("word", F.array(*[low(k) for k in range(FOLDS + 1)]).alias("low")).where(F.exists("low", lambda x: x >= 0.6)).collect()
    return [{r["word"]: float(r["low"][k]) for r in top if (r["low"][k] or 0) >= 0.6} for k in range(FOLDS + 1)]


def lower_end(a: Column, n: Column, z: float = 1.96) -> Column:
    """Of the interval of a share a / n."""
    p = a / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fold_of(text: str) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


class Trees:
    """Boosted trees of one depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)])
        f = np.full(len(y), self.base)
        self.trees: list[list[tuple[int, float, float]]] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            tree, step = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += step

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, float, float]], np.ndarray]:
        """Nodes in heap order as (feature or -1, threshold, value)."""
        nodes = [(-1, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1)
        step, todo = np.zeros(len(g)), [(0, np.arange(len(g)))]
        for node, at in todo:
            gs, hs = g[at].sum(), h[at].sum()
            best = (1e-6, None)
            if node < 2**DEPTH - 1 and len(at) >= 2 * LEAF:
                for j, edges in enumerate(self.edges):
                    if not len(edges):
                        continue
                    col, m = b[at, j], len(edges) + 1
                    gl, hl, n = (np.cumsum(np.bincount(col, w, m))[:-1] for w in (g[at], h[at], None))
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(n < LEAF) | (len(at) - n < LEAF)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1] is None:
                value = SHRINK * gs / (hs + 1)
                nodes[node], step[at] = (-1, 0.0, value), value
            else:
                j, k = best[1]
                nodes[node] = (j, float(self.edges[j][k]), 0.0)
                left = b[at, j] <= k
                todo += [(2 * node + 1, at[left]), (2 * node + 2, at[~left])]
        return nodes, step

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            feature, threshold, value = (np.array(c) for c in zip(*tree))
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > threshold[at]), at)
            out += value[at]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots (mean score, share of ones), both ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        blocks.append([float(s), float(v), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            b = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], b)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        """``x`` are features by lexicons that do not know the row's own part ``fold``."""
        self.lexicon, self.share, self.trees = lexicon, float(y.mean()) if len(y) else 0.0, None
        parts = [fold == k for k in range(FOLDS)]
        if len(y) >= 30 and all(0 < y[~part].sum() < (~part).sum() for part in parts):
            raw = np.empty(len(y))
            for part in parts:
                raw[part] = Trees(x[~part], y[~part]).raw(x[part])
            self.at, self.to = isotonic(raw, y)
            self.trees = Trees(x, y)

    def score(self, texts) -> np.ndarray:
        x = np.array([features(t or "", self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        if self.trees is None:
            return np.full(len(x), self.share)
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, self.at, self.to)
        return np.clip(calibrated + 1e-4 * np.tanh(raw), 0, 1)  # keeps the order inside a pooled block


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, left_out: int = 0, bound: int = SAMPLE) -> Model:
    trusted = labelled(labels, "toxic", remainder(F.col("doc_id"), modulus) != left_out, bound)
    rows = docs.select("doc_id", "text").join(F.broadcast(trusted), "doc_id").withColumn("fold", fold_of("text"))
    lexicons = learn_lexicons(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["doc_id", "label", "fold"]].assign(x=[list(features(t or "", lexicons[k])) for t, k in zip(b["text"], b["fold"])])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInPandas(run, f"doc_id {kind}, label int, fold int, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    column = lambda name, kind: np.array([r[name] for r in got], kind)
    return Model(lexicons[-1], column("x", np.float64).reshape(-1, len(FEATURES)), column("label", np.float64), column("fold", np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score and predicted."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(model.score(x))

    return make_room(docs, "score", "predicted").withColumn("score", run("text")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
