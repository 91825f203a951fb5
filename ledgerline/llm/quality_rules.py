"""Quality rules: a learned decision list, applied as ordered Spark conditions.

Counts over the whole text become rates; sequential covering learns from labelled
rows: a rule starts empty, grows by the threshold condition with the most information
gain on the growing part, is pruned from its end on the pruning part, and enters the
list if it is precise there; the rows it covers leave, and the next rule is grown. The
list is a chain of CASE conditions, so scoring stays inside the JVM. Only numbers of a
bounded sample of labelled rows (``textstats.SAMPLE``) reach the driver.

Defined results: null or empty text has no words and fails the base rule; a document
that no rule covers is kept; repeated rows are judged alike; without labelled rows of
both kinds the list is empty; an empty table gives no rows; extra columns stay, those
that are named like a result under another name (underscores in front).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, make_room, table
from .textstats import labelled, rates, with_counts

Condition = tuple[str, str, float]  # rate, "<=" or ">", threshold
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 40
PRECISION, COVER = 0.9, 0.004  # of an accepted rule on the pruning part; least share of the rejected rows' weight it covers

#: Rates that a rule may use. Length is the base rule's business.
RULE_RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "digit_rate", "shout_rate", "unique_rate")


def holds(rule: list[Condition], row: dict[str, float]) -> bool:
    return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in rule)


def _score(rows: list[tuple[dict, int]], rule: list[Condition]) -> tuple[int, int]:
    bad = good = 0
    for x, y in rows:
        if holds(rule, x):
            bad, good = bad + (y == 0), good + (y == 1)
    return bad, good


def grow(rows: list[tuple[dict, int]], names: tuple[str, ...]) -> list[Condition]:
    """Adds the condition with the most gain until none helps or the rule is pure."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        bad = sum(y == 0 for _, y in rows)
        good = len(rows) - bad
        if not bad or not good:
            break
        before, best = math.log2(bad / len(rows)), (1e-9, None)
        for f in names:
            order = sorted((x[f], y) for x, y in rows)
            cuts = sorted({order[i * len(order) // CUTS][0] for i in range(1, CUTS)} | {order[-1 - i * len(order) // (4 * CUTS)][0] for i in range(1, 4)})
            at = b = g = 0
            for t in cuts:
                if t == order[-1][0]:
                    break
                while order[at][0] <= t:
                    b, g, at = b + (order[at][1] == 0), g + (order[at][1] == 1), at + 1
                for op, p, q in (("<=", b, g), (">", bad - b, good - g)):
                    if p and p + q < len(rows):  # the threshold is half way to the next value
                        best = max(best, (p * (math.log2(p / (p + q)) - before), (f, op, (t + order[at][0]) / 2)), key=lambda v: v[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [(x, y) for x, y in rows if holds([best[1]], x)]
    return rule


def prune(rows: list[tuple[dict, int]], rule: list[Condition]) -> list[Condition]:
    """The start of the rule that does best on rows it was not grown on."""

    def worth(k: int) -> float:
        bad, good = _score(rows, rule[:k])
        return (bad - good) / (bad + good) if bad + good else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (round(worth(k), 3), -k))] if rule else rule


def learn(rows: list[tuple[dict, int]], names: tuple[str, ...] = RULE_RATES) -> list[list[Condition]]:
    """The ordered list of rules that reject; every third row prunes."""
    growing, pruning = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    out: list[list[Condition]] = []
    total = sum(y == 0 for _, y in pruning)
    while len(out) < MAX_RULES:
        rule = prune(pruning, grow(growing, names))
        if not rule:
            break
        bad, good = _score(pruning, rule)
        if bad < max(2, COVER * total) or bad < PRECISION * (bad + good):
            break
        out.append(rule)
        growing, pruning = ([r for r in part if not holds(rule, r[0])] for part in (growing, pruning))
    return out


def condition(rule: list[Condition], columns: dict[str, Column]) -> Column:
    out = F.lit(True)
    for f, op, t in rule:
        out = out & (columns[f] <= F.lit(t) if op == "<=" else columns[f] > F.lit(t))
    return out


def fit(docs: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """Learns from labelled documents (label 1: keep) that the base rule leaves."""
    sample = labelled(labels, "quality", F.lit(True))  # bounded by SAMPLE, so it can be broadcast
    rows = with_counts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "counts").select("doc_id", "label", *[c.alias(n) for n, c in rates().items() if n in RULE_RATES], F.col("counts.n_words").alias("n"), F.col("counts.n_repeat_words").alias("r")).collect()
    rows = [r for r in rows if r["n"] >= MIN_WORDS and 100 * r["r"] <= MAX_REPEAT_PERCENT * r["n"]]  # a filter in the plan would go below the join, and count the words of every document
    rows.sort(key=lambda r: (hash((r["doc_id"] * 2654435761) % (1 << 32)) if isinstance(r["doc_id"], int) else 0, str(r["doc_id"]), tuple(r[f] for f in RULE_RATES)))
    return learn([({f: float(r[f]) for f in RULE_RATES}, r["label"]) for r in rows])


def apply_rules(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule (number of the first that fires, from 1) and kept."""
    docs = make_room(docs, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
    counts = fresh(docs, "counts")[0]
    x = with_counts(docs, counts)
    n, repeat = F.col(f"{counts}.n_words"), F.col(f"{counts}.n_repeat_words")
    columns = rates(counts)
    fired = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        fired = F.when(condition(rule, columns), F.lit(k)).otherwise(fired)
    x = x.withColumns({c: F.col(f"{counts}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")} | {"base_failed": (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n), "rule": fired})
    return x.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(counts)


def kept_documents(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Rows of ``docs`` that are kept, with their own columns only."""
    judged = apply_rules(docs.select(F.struct("*").alias("own"), "text"), rules)
    return judged.where("kept").select("own.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).drop("text")
