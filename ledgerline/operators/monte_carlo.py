"""Bootstrap of trade sequences: every simulation draws as many trades as there are, with replacement or as a new order.

A simulation compounds a share of 1 / TOP_N of the equity in each drawn trade, in turn.
Trades are numbered by their return, equal returns next to each other, so the table of
distinct returns with counts and first numbers stands for all trades. The number drawn at
a position follows from (seed, simulation, position) alone: a generator of the path, moved
on to a part of BLOCK positions, or a keyed permutation of the numbers, whose rounds are tables of
about a square root of n. So parts of one path
are walked in tasks of their own, in any order and again after a loss. A part leaves its total, highest
and lowest level and its own drawdown; these merge in order.

A number drawn with replacement is n times a fraction of 64 bits, rounded down (its chance is
1 / n to within 2 ** -64). The generator gives the leading HEAD bits, and these alone tell the
return but where two returns meet in a cell; only there are the other bits, a hash of the
place, made. Draws lie step by step of the lanes that walk them, those of a new order too: there
the row a number is in tells the return but where two returns meet.

Up to HOLD distinct returns go to every task. Beyond, drawn numbers go to the block of
numbers they fall into and come back with returns: no task holds more than GROUP parts of
BLOCK draws. Both give the same rows. Neither trades nor draws pass the driver.

Defined results: growth is also given as its logarithm, as total_return is beyond a
double (infinite) on long paths; a trade that loses the whole equity or more ends the
path at a loss of 100 %; without trades there are no simulations; a null, undefined or
infinite return is no trade; equal returns are equal trades.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order
from .keep import kept
from .ranges import FIRST, cuts, default_ranges, with_range

SIMULATIONS, TOP_N, SEED = 2000, 5, 42
BLOCK = 1 << 16  # positions of a part, and trade numbers of a block
CHUNK = 1 << 14  # positions drawn at a time: arrays that stay in a core's cache
LANE = 32  # steps of a part that are walked one by one
TOGETHER = 4  # parts that are drawn and walked side by side
HEAD = 16  # bits of a draw that its generator gives, the others are hashed
GROUP = 32  # simulations whose draws from one block meet in one task
HOLD = 1 << 22  # distinct returns that every task may hold (24 bytes each)
TASKS = 48  # parts that the work is dealt to, at least
ROUNDS = 6  # of the permutation
COLUMNS = ["simulation", "part", "total", "high", "low", "deepest"]
PARTS = "simulation long, part long, total double, high double, low double, deepest double"


@lru_cache(64)
def _keys(key: tuple[int, ...], kind: type) -> np.ndarray:
    return np.random.default_rng(key).integers(0, np.iinfo(kind).max, ROUNDS, kind, endpoint=True)


def _sides(n: int) -> tuple[int, int]:
    """Rows and columns of numbers below n: a row are numbers that follow each other, only the last may reach beyond."""
    rows = math.isqrt(max(n - 1, 0)) + 1
    return rows, -(-n // rows)


def _shift(x: np.ndarray, own: np.integer, m: np.integer) -> np.ndarray:
    """What a round of the permutation adds to the other half of a place: below m."""
    c0, c1, s0, s1 = (0x9E3779B1, 0x85EBCA77, 15, 16) if x.dtype == np.uint32 else (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 29, 32)
    c0, c1, s0, s1 = (x.dtype.type(v) for v in (c0, c1, s0, s1))
    z, t = np.empty_like(x), np.empty_like(x)
    np.multiply(np.bitwise_xor(x, own, out=z), c0, out=z)
    np.bitwise_xor(z, np.right_shift(z, s0, out=t), out=z)
    np.multiply(z, c1, out=z)
    np.bitwise_xor(z, np.right_shift(z, s1, out=t), out=z)
    return np.subtract(z, np.multiply(np.floor_divide(z, m, out=t), m, out=t), out=z)  # z mod m


def _kind(n: int) -> type:
    return np.uint32 if n <= 1 << 31 else np.uint64


def permuted(places: np.ndarray, n: int, key: Sequence[int]) -> np.ndarray:
    """Where a keyed permutation of 0 to n - 1 takes the places: a Feistel network over rows and columns of the least square that holds n, walked on until it is below n. Places run down the columns."""
    kind = _kind(n)
    sizes = [kind(m) for m in _sides(n)]

    def once(x: np.ndarray) -> np.ndarray:
        b = x // sizes[0]
        a = x - b * sizes[0]
        t = np.empty_like(x)
        for k, own in enumerate(_keys(tuple(key), kind)):
            (moved, other), m = ((a, b), (b, a))[k % 2], sizes[k % 2]
            np.add(moved, _shift(other, own, m), out=moved)
            np.minimum(moved, np.subtract(moved, m, out=t), out=moved)  # below m, the difference wraps around and is greater
        return a * sizes[1] + b

    x = once(places.astype(kind))
    while (out := x >= n).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


class Order:
    """``permuted`` for places that follow each other: what a round adds depends on one half of a place alone and is looked up.

    Down a column the first round turns the rows and the second adds what lies in a row, so neither is looked up place by place. Halves are
    not brought below their size after a round; a table is repeated as often as they may exceed it.
    """

    def __init__(self, n: int, key: Sequence[int]):
        self.n, self.key, (self.rows, self.columns) = n, key, _sides(n)
        sizes, kind = (self.rows, self.columns), _kind(n)
        self.turns, added, *more = (_shift(np.arange(sizes[1 - k % 2], dtype=kind), own, kind(sizes[k % 2])).astype(np.int64) for k, own in enumerate(_keys(tuple(key), kind)))
        self.added, self.row = np.tile(added, 2), np.tile(np.arange(self.rows), 2)
        self.tables = [np.tile(x, times) for x, times in zip(more, (2, 2, 3, 3), strict=True)]
        self.room = np.empty((3, CHUNK), np.int64)

    def halves(self, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows, and columns before the last round, which leaves rows alone; both up to three times their size. Up to CHUNK places, good until the next call."""
        a, b, z = self.room[:, :count]
        at = 0
        while at < count:
            column, row = divmod(first + at, self.rows)
            size, turn = min(self.rows - row, count - at), (row + int(self.turns[column])) % self.rows
            a[at : at + size] = self.row[turn : turn + size]
            np.add(self.added[turn : turn + size], column, out=b[at : at + size])
            at += size
        for k, (moved, other) in enumerate(((a, b), (b, a), (a, b))):
            np.add(moved, np.take(self.tables[k], other, out=z, mode="wrap"), out=moved)  # no half is beyond its table; "raise" would copy
        return a, b

    def numbers(self, first: int, count: int) -> np.ndarray:
        x = np.empty(count, np.int64)
        for at in range(0, count, CHUNK):
            a, b = self.halves(first + at, min(CHUNK, count - at))
            x[at : at + CHUNK] = a % self.rows * self.columns + (b + self.tables[3][a]) % self.columns
        if (out := (x >= self.n).nonzero()[0]).size:
            x[out] = permuted(x[out], self.n, self.key)
        return x


order_of = lru_cache(2)(Order)


def hashed(key: np.uint64, places: np.ndarray) -> np.ndarray:
    """64 bits for each place: what a SplitMix64 generator that starts at the key gives there."""
    x = (places.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + key
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def below(n: int, x: np.ndarray) -> np.ndarray:
    """n * x / 2 ** 64 rounded down, for 64-bit x: the high half of the product, by halves of its factors."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a, b, c, d = x >> half, x & low, np.uint64(n >> 32), np.uint64(n & 0xFFFFFFFF)
    e = a * d + (b * d >> half)
    out = a * c + (e >> half) + (b * c + (e & low) >> half) if c else e >> half
    return out.astype(np.int64)


@dataclass(frozen=True)
class Draws:
    """What is drawn: numbers below n, for parts of ``block`` positions."""

    n: int
    seed: int = SEED
    method: str = "bootstrap"
    block: int = BLOCK

    @property
    def parts(self) -> int:
        return -(-self.n // self.block)

    def size(self, part: int) -> int:
        return min(self.block, self.n - part * self.block)

    def heads(self, simulation: int, part: int, many: int = 1) -> tuple[np.ndarray, int]:
        """The leading bits of the draws of some parts of a size, a row for each part and step of its lanes, and the place of the first."""
        width = -(-self.size(part) // LANE)
        first, count = part * -(-self.block // LANE) * LANE, many * LANE * width
        own = np.random.default_rng([self.seed, simulation]).bit_generator.advance(first * HEAD // 64)
        return own.random_raw(-(-count * HEAD // 64)).astype("<u8", copy=False).view(f"<u{HEAD // 8}")[:count].reshape(many, LANE, width), first

    def drawn(self, simulation: int, heads: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The numbers that are drawn at places of a path, with these heads."""
        return below(self.n, heads.astype(np.uint64) << np.uint64(64 - HEAD) | hashed(_keys((self.seed, simulation, 1), np.uint64)[0], places) >> np.uint64(HEAD))

    def laid(self, values: np.ndarray) -> np.ndarray:
        """What is drawn at the places of a part of a new order by step of its lanes; a lane that is not full stays where it ends."""
        width = -(-len(values) // LANE)
        full = len(values) - (width - 1) * LANE  # steps of all lanes
        if full == LANE:
            return values.reshape(LANE, width)
        lanes = np.zeros((LANE, width), values.dtype)
        lanes[:full] = values[: full * width].reshape(full, width)
        lanes[full:, : width - 1] = values[full * width :].reshape(LANE - full, width - 1)
        return lanes

    def numbers(self, simulation: int, part: int) -> np.ndarray:
        """The numbers of the trades at the positions of a part."""
        if self.method == "shuffle":
            return self.laid(order_of(self.n, (self.seed, simulation)).numbers(part * self.block, self.size(part))).T.ravel()[: self.size(part)]
        heads, first = self.heads(simulation, part)
        return self.drawn(simulation, heads, first + np.arange(heads.size).reshape(heads.shape))[0].T.ravel()[: self.size(part)]

    def path(self, simulation: int) -> np.ndarray:
        """The numbers of a whole path."""
        return np.concatenate([self.numbers(simulation, part) for part in range(self.parts)])


def growth(pnl_pct: np.ndarray) -> np.ndarray:
    """log of equity after over before a trade."""
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(1 + pnl_pct / 100 / TOP_N, 0))


def walk(steps: np.ndarray) -> tuple[float, float, float, float]:
    """What a part leaves, from its steps in order; a lane that is not full stays where it ends."""
    missing = -len(steps) % LANE
    return walked((np.pad(steps, (0, missing)) if missing else steps).reshape(1, -1, LANE).transpose(0, 2, 1))[0]


def _levels(rows: Iterable[np.ndarray], shape: tuple[int, ...]) -> list[np.ndarray]:
    """level, high, low and deepest of each lane, from its steps one by one."""
    level, high, low, deepest = np.zeros(shape), np.zeros(shape), np.full(shape, np.inf), np.zeros(shape)
    fall = np.empty(shape)
    for row in rows:
        np.add(level, row, out=level)
        np.maximum(high, level, out=high)
        np.minimum(low, level, out=low)
        np.minimum(deepest, np.subtract(level, high, out=fall), out=deepest)
    return [level, high, low, deepest]


def _ends(level: np.ndarray, high: np.ndarray, low: np.ndarray, deepest: np.ndarray) -> list[tuple[float, float, float, float]]:
    """The lanes of a part merge in order."""
    many, width = level.shape
    ends, peak = np.zeros((many, width + 1)), np.zeros((many, width + 1))
    np.cumsum(level, axis=1, out=ends[:, 1:])
    np.maximum.accumulate(ends[:, :-1] + high, axis=1, out=peak[:, 1:])
    low += ends[:, :-1]
    deepest = np.minimum(deepest, low - peak[:, :-1])
    return list(zip(ends[:, -1].tolist(), peak[:, -1].tolist(), low.min(1).tolist(), deepest.min(1).tolist()))


def walked(lanes: np.ndarray) -> list[tuple[float, float, float, float]]:
    """total, high, low and deepest of each part: its last, highest (at least the start) and lowest level, and its deepest fall below a peak of its own.

    Parts and their lanes, by part and step of LANE steps, are walked side by side.
    """
    many, _, width = lanes.shape
    return _ends(*_levels((lanes[:, k] for k in range(LANE)), (many, width)))


def _undefined(x: np.ndarray) -> np.ndarray:
    """Where there are no numbers: eight at a time, as they are few."""
    there = np.isnan(x)
    if len(x) % 8:
        return there.nonzero()[0]
    left = (there.view(np.uint64).nonzero()[0][:, None] * 8 + np.arange(8)).ravel()
    return left[there[left]]


class Steps:
    """The growth of numbered trades: a guide over the leading bits of a number tells it, but where two returns meet in a cell; ``cells`` do so for the leading bits of a draw."""

    def __init__(self, pnl_pct: np.ndarray, ends: np.ndarray):
        """Distinct returns and, for each, the number after its last."""
        n = int(ends[-1])
        self.steps, self.ends = growth(pnl_pct), ends
        self.shift = max(0, (n - 1).bit_length() - min(22, max(14, len(ends).bit_length() + 6)))
        first = np.arange(((n - 1) >> self.shift) + 1) << self.shift
        self.guide = self._between(first, np.minimum(first + (1 << self.shift), n) - 1)
        head, rest = np.arange(1 << HEAD, dtype=np.uint64) << np.uint64(64 - HEAD), np.uint64((1 << 64 - HEAD) - 1)
        self.cells = self._between(below(n, head), below(n, head | rest))
        unknown = np.isnan(self.cells).mean()
        self.crowded, self.rare = unknown > 0.5, unknown * LANE < 0.25
        rows, columns = _sides(n)
        first = np.arange(rows) * columns
        own = self._between(np.minimum(first, n - 1), np.minimum(first + columns, n) - 1)
        self.rows = np.tile(np.where(first + columns > n, np.nan, own), 3)  # as often as ``Order.halves`` may exceed them
        self.mixed = np.isnan(own).mean() > 0.05

    def _between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The growth of the numbers from first to last, undefined (as no growth is) where it is not one."""
        a, b = (np.searchsorted(self.ends, at, "right") for at in (first, last))
        return np.where(a == b, self.steps[a], np.nan)

    def put(self, at: np.ndarray, out: np.ndarray) -> None:
        out[:] = self.guide[at >> self.shift]
        if (left := np.isnan(out).nonzero()[0]).size:
            out[left] = self.steps[np.searchsorted(self.ends, at[left], "right")]

    def lanes(self, drawn: Draws, simulation: int, part: int, many: int, out: np.ndarray) -> np.ndarray:
        """The lanes of some parts of a size that are drawn with replacement, in ``out``."""
        heads, first = drawn.heads(simulation, part, many)
        own, flat, lanes = out[: heads.size], heads.ravel(), out[: heads.size].reshape(heads.shape)
        if self.crowded:
            for at in range(0, heads.size, CHUNK):
                some = np.arange(at, min(at + CHUNK, heads.size))
                self.put(drawn.drawn(simulation, flat[at : at + CHUNK], first + some), own[at : at + CHUNK])
        else:
            np.take(self.cells, flat, out=own, mode="wrap")  # every head has a cell; "raise" would copy
            unknown = np.isnan(own)
            some = unknown.view(np.uint64).nonzero()[0]  # eight at a time, as few are unknown
            for at in range(0, len(some), CHUNK // 8):
                left = (some[at : at + CHUNK // 8, None] * 8 + np.arange(8)).ravel()
                left = left[unknown[left]]
                found = np.empty(len(left))
                self.put(drawn.drawn(simulation, flat[left], first + left), found)
                own[left] = found
        if missing := LANE * lanes.shape[2] - drawn.size(part):
            lanes[:, LANE - missing :, -1] = 0  # a lane that is not full stays where it ends
        return lanes

    def new_order(self, drawn: Draws, simulation: int, part: int, many: int, out: np.ndarray) -> np.ndarray:
        """The lanes of some parts of a size of a new order, in ``out``; several only if their lanes are full."""
        new, first = order_of(drawn.n, (drawn.seed, simulation)), part * drawn.block
        own = out[: many * drawn.size(part)]
        for at in range(0, len(own), CHUNK):
            some = own[at : at + CHUNK]
            if self.mixed:
                self.put(new.numbers(first + at, len(some)), some)
            else:
                np.take(self.rows, new.halves(first + at, len(some))[0], out=some, mode="wrap")
        if not self.mixed and (left := _undefined(own)).size:
            found = np.empty(len(left))
            self.put(permuted(first + left, drawn.n, (drawn.seed, simulation)), found)
            own[left] = found
        return own.reshape(many, LANE, -1) if many > 1 else drawn.laid(own)[None]

    def walked(self, drawn: Draws, simulation: int, part: int, many: int, out: np.ndarray) -> list[tuple[float, float, float, float]]:
        """What some parts of a size leave; ``out`` has room for their steps."""
        if drawn.method == "shuffle":
            return walked(self.new_order(drawn, simulation, part, many, out))
        if not self.rare or drawn.size(part) % LANE:
            return walked(self.lanes(drawn, simulation, part, many, out))
        heads, first = drawn.heads(simulation, part, many)
        row, width = out[: many * heads.shape[2]].reshape(many, -1), heads.shape[2]
        found = _levels((np.take(self.cells, heads[:, k], out=row, mode="wrap") for k in range(LANE)), row.shape)
        part, lane = np.isnan(found[0]).nonzero()  # lanes with an unknown step, few, are walked again
        if part.size:
            some = heads[part, :, lane]
            steps = self.cells[some]
            k, step = np.isnan(steps).nonzero()
            known = np.empty(len(k))
            self.put(drawn.drawn(simulation, some[k, step], first + (part[k] * LANE + step) * width + lane[k]), known)
            steps[k, step] = known
            for x, again in zip(found, _levels(np.ascontiguousarray(steps.T), part.shape)):
                x[part, lane] = again
        return _ends(*found)


def merged(parts: DataFrame) -> DataFrame:
    """simulation, level, deepest (and n_draws if parts have n): the parts of a path in order, a row each."""
    w = Window.partitionBy("simulation").orderBy("part").rowsBetween(FIRST, -1)
    x = parts.withColumn("start", F.coalesce(F.sum("total").over(w), F.lit(0.0)))
    x = x.withColumn("peak", F.greatest(F.max(F.col("start") + F.col("high")).over(w), F.lit(0.0)))
    x = x.withColumn("deepest", F.least("deepest", F.col("start") + F.col("low") - F.col("peak")))
    counts = [F.sum("n").alias("n_draws")] if "n" in parts.columns else []
    return x.groupBy("simulation").agg(F.max_by(F.col("start") + F.col("total"), "part").alias("level"), F.min("deepest").alias("deepest"), *counts)


def _held(values: DataFrame, drawn: Draws, simulations: int, tasks: int) -> DataFrame:
    """The parts, every task with all distinct returns."""
    items = simulations * drawn.parts
    tasks = min(tasks, items)
    sent = values.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, "task")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not (frames := list(batches)):
            return
        x = pd.concat(frames).sort_values("before_")
        task, steps = int(x["task"].iloc[0]), Steps(x["v_"].to_numpy(), (x["before_"] + x["c_"]).to_numpy())
        item, last, rows = task * items // tasks, (task + 1) * items // tasks, []
        own = np.empty(TOGETHER * -(-min(drawn.block, drawn.n) // LANE) * LANE)
        while item < last:
            simulation, part = divmod(item, drawn.parts)
            many = max(1, min(TOGETHER if drawn.block % LANE == 0 else 1, last - item, drawn.parts - 1 - part))  # the last part of a path may be smaller
            found = steps.walked(drawn, simulation, part, many, own)
            rows += [(simulation, part + k, *x) for k, x in enumerate(found)]
            item += len(found)
        yield pd.DataFrame(rows, columns=COLUMNS)

    return sent.mapInPandas(run, PARTS)


def _met(values: DataFrame, drawn: Draws, simulations: int, tasks: int) -> DataFrame:
    """The parts, draws sent to the blocks of numbers and back."""
    items, groups = simulations * drawn.parts, -(-simulations // GROUP)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for simulation, part in (divmod(int(i), drawn.parts) for b in batches for i in b["id"]):
            at = drawn.numbers(simulation, part)
            places = np.argsort(at // drawn.block, kind="stable")
            at = at[places]
            cut = np.flatnonzero(np.diff(at // drawn.block)) + 1
            yield pd.DataFrame({"block": at[np.r_[0, cut]] // drawn.block, "set": simulation // GROUP, "simulation": simulation, "part": part, "places": np.split(places.astype(np.int32), cut), "at": np.split(at, cut)})

    def look_up(asked: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("before_")
        steps, starts = growth(there["v_"].to_numpy()), there["before_"].to_numpy()
        found = [steps[np.searchsorted(starts, at, "right") - 1] for at in asked["at"]]
        return asked[["simulation", "part", "places"]].assign(steps=pd.Series(found, asked.index, dtype=object))

    def put_together(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        path = np.empty(sum(map(len, x["places"])))
        for places, steps in zip(x["places"], x["steps"]):
            path[places] = steps
        return pd.DataFrame([(*key, *walk(path))], columns=COLUMNS)

    asked = values.sparkSession.range(0, items, 1, min(tasks, items)).mapInPandas(draw, "block long, set long, simulation long, part long, places array<int>, at array<long>")
    blocks = F.sequence(F.floor(F.col("before_") / drawn.block), F.floor((F.col("before_") + F.col("c_") - 1) / drawn.block))
    there = values.select(F.explode(blocks).alias("block"), "v_", "before_").withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = asked.groupBy("block", "set").cogroup(there.groupBy("block", "set")).applyInPandas(look_up, "simulation long, part long, places array<int>, steps array<double>")
    return found.groupBy("simulation", "part").applyInPandas(put_together, PARTS)


def _own(trades: DataFrame, *more: str) -> DataFrame:
    """Rows that are trades."""
    pnl = F.col("pnl_pct").cast("double")
    return trades.where(~F.isnan(pnl) & (F.abs(pnl) < float("inf"))).select(pnl.alias("pnl_pct"), *more)


def _percent(paths: DataFrame, *more: str | Column) -> DataFrame:
    return paths.select("simulation", *more, F.col("level").alias("log_growth"), (F.expm1("level") * 100).alias("total_return"), (F.expm1("deepest") * 100).alias("max_drawdown"))


def tally(trades: DataFrame) -> DataFrame:
    """v_, c_, before_: the distinct returns with their counts and first numbers; several simulations may share them."""
    return kept(order.counted(_own(trades), "pnl_pct").select("v_", F.col("c_").cast("long").alias("c_"), F.col("before_").cast("long").alias("before_")), "tally")


def simulate(trades: DataFrame | None, simulations: int = SIMULATIONS, seed: int = SEED, method: str = "bootstrap", hold: int = HOLD, block: int = BLOCK, values: DataFrame | None = None) -> DataFrame:
    """simulation, n_draws, log_growth, total_return and max_drawdown (percent) from ``trades`` (pnl_pct), or from their ``tally``."""
    if method not in ("bootstrap", "shuffle"):
        raise ValueError(f"no such method: {method}")
    values = tally(trades) if values is None else values
    spark = values.sparkSession
    size = values.agg(F.count("*").alias("distinct"), F.coalesce(F.sum("c_"), F.lit(0)).alias("n")).first()
    drawn = Draws(size["n"], seed, method, block)
    if not drawn.n or not simulations:
        return spark.createDataFrame([], "simulation long, n_draws long, log_growth double, total_return double, max_drawdown double")
    form = _held if size["distinct"] <= hold else _met
    parts = form(values, drawn, simulations, max(TASKS, 3 * spark.sparkContext.defaultParallelism))
    return _percent(merged(parts), F.lit(drawn.n).cast("long").alias("n_draws"))


def happened(trades: DataFrame, on: str, ties: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """n_draws, log_growth, total_return, max_drawdown of the trades in the order that happened, by ranges of ``on``; a row, or none without trades."""
    own = _own(trades, on, *ties)
    x = with_range(own, on, cuts(own, on, ranges or default_ranges(trades)), "part")
    rate = 1 + F.col("pnl_pct") / 100 / TOP_N
    w = Window.partitionBy("part").orderBy(on, *ties).rowsBetween(FIRST, 0)
    x = x.withColumn("path", F.sum(F.when(rate > 0, F.log(rate)).otherwise(float("-inf"))).over(w)).withColumn("at", F.count("*").over(w))
    x = x.withColumn("peak", F.greatest(F.max("path").over(w), F.lit(0.0)))
    parts = x.groupBy("part").agg(F.count("*").alias("n"), F.max_by("path", "at").alias("total"), F.max("peak").alias("high"), F.min("path").alias("low"), F.min(F.col("path") - F.col("peak")).alias("deepest"))
    parts = parts.withColumn("simulation", F.lit(0))  # a row for each range
    return _percent(merged(parts), "n_draws").drop("simulation")


def bands(simulated: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """n_simulations, bands of 100 * log_growth and of max_drawdown, the chance of a loss; with ``known`` (one row of ``happened``) also its ranks.

    Bands of logarithms stay finite where total_return is beyond a double; the logarithm keeps the order of returns, so ranks and chances are those of total_return. Growths that agree to nine digits (decimals, below 1) are equal:
    another order of the same trades has no other return, and its rank says nothing.
    """
    r, d = F.col("log_growth") * 100, F.col("max_drawdown")
    own = {f"log_return_p{q}": F.percentile(r, q / 100) for q in (5, 25, 50, 75, 95)} | {f"drawdown_p{q}": F.percentile(d, q / 100) for q in (5, 50, 95)}
    own |= {"prob_negative_return": F.count_if(r < 0) / F.count("*") * 100}
    x = simulated
    if known is not None:
        x = x.crossJoin(F.broadcast(known.select(F.col("log_growth").alias("known_"), F.col("max_drawdown").alias("known_drawdown_"))))  # one row
        own |= {"known_return_percentile": F.count_if(F.col("log_growth") < F.col("known_") - 1e-9 * F.greatest(F.abs("known_"), F.lit(1.0))) / F.count("*") * 100, "known_drawdown_percentile": F.count_if(d < F.col("known_drawdown_")) / F.count("*") * 100}
    return x.agg(F.count("*").alias("n_simulations"), *[F.round(c, 2).alias(k) for k, c in own.items()])
