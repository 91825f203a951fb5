"""First passage: what a position meets first on the bars behind it, found by tables of block extremes.

The bars of a ticker are cut into blocks of SIZE. A row of ``blocks`` holds the bars of a
block and of some behind it; a row of ``extremes`` holds, for WIDTH blocks and some
behind them, each block's lowest low, highest high, deepest drop from a high to a low of
the same or a later bar, and last date. A search reads the first bars, then block
extremes until one says that a level is broken in it, then the bars of that block: one
row of either table at each step, however far away the bar is. So a position crosses
the network three times, with as many numbers as it looks at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, WIDTH = 16, 16


def block_of(place: Column, size: int = SIZE) -> Column:
    return F.floor(place / size)


def blocks(numbered: DataFrame, columns: Sequence[str], out: str = "bars_", size: int = SIZE) -> DataFrame:
    """ticker, block_, ``out``: the bars (i, columns) of a block in order. The tables below are made of this one, so that bars are gathered once."""
    x = numbered.select("ticker", block_of(F.col("i"), size).alias("block_"), F.struct("i", *columns).alias("bar_"))
    return x.groupBy("ticker", "block_").agg(F.sort_array(F.collect_list("bar_")).alias(out))


def followed(base: DataFrame, ahead: int, of: str = "bars_") -> DataFrame:
    """Blocks with the bars of the ``ahead`` blocks behind them."""
    if not ahead:
        return base
    x = base.select("ticker", F.expr(f"explode(sequence(greatest(block_ - {ahead}, 0), block_))").alias("at_block_"), F.struct("block_", of).alias("own_"))
    return x.groupBy("ticker", F.col("at_block_").alias("block_")).agg(F.expr(f"flatten(transform(sort_array(collect_list(own_)), x -> x.{of}))").alias(of))


_DEEPEST = """aggregate(bars_, struct(cast(null as double) as top, cast(null as double) as drop),
  (s, b) -> struct(greatest(s.top, cast(b.high as double)) as top, greatest(s.drop, greatest(s.top, cast(b.high as double)) - b.low) as drop)).drop"""


def extremes(base: DataFrame, ahead: int = 0, out: str = "parts_", width: int = WIDTH) -> DataFrame:
    """ticker, span_, ``out``: (block, hi, lo, drop, last) of ``width`` blocks and of ``ahead`` times as many behind them, in order."""
    own = f"struct(block_ as block, array_max(bars_.high) as hi, array_min(bars_.low) as lo, {_DEEPEST} as drop, array_max(bars_.date) as last)"
    x = base.select("ticker", F.expr(own).alias("part_"))
    x = x.select("ticker", F.expr(f"explode(sequence(greatest(floor(part_.block / {width}) - {ahead}, 0), floor(part_.block / {width})))").alias("span_"), "part_")
    return x.groupBy("ticker", "span_").agg(F.sort_array(F.collect_list("part_")).alias(out))


def spans_needed(bars: int, size: int = SIZE, width: int = WIDTH) -> int:
    """How many spans behind the first one so many bars reach into."""
    return -(-(bars // size + 2) // width)


def first_block(parts: str, low: str, high: str, peak: str, broken: str) -> str:
    """(peak, block): the first block from ``low`` to ``high`` for which ``broken``, a condition on the part p and the peak s.peak before it, holds; null if there is none."""
    return f"""aggregate(filter({parts}, p -> p.block >= {low} and p.block <= {high}), struct(cast({peak} as double) as peak, cast(null as bigint) as block),
      (s, p) -> case when s.block is not null then s when {broken} then struct(s.peak as peak, p.block as block) else struct(greatest(s.peak, cast(p.hi as double)) as peak, cast(null as bigint) as block) end)"""
