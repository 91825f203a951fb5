"""One text, two engines: the few places where Spark SQL and the oracle's SQL differ."""

from __future__ import annotations


class Spark:
    """Spark SQL."""

    name = "spark"

    def first_by(self, x: str, *keys: str) -> str:
        return f"min_by({x}, struct({', '.join(keys)}))"

    def last_by(self, x: str, *keys: str) -> str:
        return f"max_by({x}, struct({', '.join(keys)}))"

    def days(self, a: str, b: str) -> str:
        return f"datediff({b}, {a})"

    def plus_days(self, d: str, n: str) -> str:
        return f"date_add({d}, {n})"

    def plus_months(self, d: str, n: str) -> str:
        return f"add_months({d}, {n})"

    def trunc(self, unit: str, d: str) -> str:
        return f"cast(date_trunc('{unit}', {d}) as date)"

    def hour(self, ts: str) -> str:
        return f"cast(date_trunc('hour', {ts}) as timestamp_ntz)"

    def carried(self, x: str, over: str) -> str:
        return f"last_value({x}) ignore nulls over ({over})"

    def coming(self, x: str, over: str) -> str:
        return f"first_value({x}) ignore nulls over ({over})"

    def quantile(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})"

    def series(self, name: str, n: str, table: str = "t") -> str:
        """A table of 0 ... n - 1."""
        return f"(select explode(sequence(cast(0 as bigint), cast({n} - 1 as bigint))) as {name}) {table}"

    def skew(self, x: str) -> str:
        """Unbiased."""
        return f"skewness({x}) * sqrt(count({x}) * (count({x}) - 1.0)) / nullif(count({x}) - 2.0, 0)"

    def parse_date(self, text: str) -> str:
        return f"date '{text}'"

    def year(self, d: str) -> str:
        return f"cast(year({d}) as bigint)"

    def weekday(self, d: str) -> str:
        """Monday is 0."""
        return f"cast(weekday({d}) as bigint)"


class Duck(Spark):
    """The oracle's."""

    name = "duck"

    def first_by(self, x: str, *keys: str) -> str:
        return f"arg_min({x}, {{{', '.join(f'k{i}: {k}' for i, k in enumerate(keys))}}})"

    def last_by(self, x: str, *keys: str) -> str:
        return f"arg_max({x}, {{{', '.join(f'k{i}: {k}' for i, k in enumerate(keys))}}})"

    def days(self, a: str, b: str) -> str:
        return f"date_diff('day', {a}, {b})"

    def plus_days(self, d: str, n: str) -> str:
        return f"cast({d} + cast({n} as integer) as date)"

    def plus_months(self, d: str, n: str) -> str:
        return f"cast({d} + to_months(cast({n} as integer)) as date)"

    def hour(self, ts: str) -> str:
        return f"date_trunc('hour', {ts})"

    def carried(self, x: str, over: str) -> str:
        return f"last_value({x} ignore nulls) over ({over})"

    def coming(self, x: str, over: str) -> str:
        return f"first_value({x} ignore nulls) over ({over})"

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def series(self, name: str, n: str, table: str = "t") -> str:
        return f"(select unnest(range(cast({n} as bigint))) as {name}) {table}"

    def skew(self, x: str) -> str:
        return f"skewness({x})"

    def weekday(self, d: str) -> str:
        return f"cast(isodow({d}) - 1 as bigint)"
