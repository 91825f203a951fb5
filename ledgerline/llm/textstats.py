"""Counts over whole texts as Spark expressions, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE = 20_000  # bound on the labelled rows (and on the unlabelled ones) that a model is fitted on

#: A lambda binds an array once: a plain column would be computed again wherever it is named.
_REPEATED = """
if(size(w) < 4, 0, transform(array(sort_array(transform(sequence(0, size(w) - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i)))),
  s -> size(array_distinct(flatten(transform(
    filter(s, (e, k) -> (k > 0 and s[greatest(k - 1, 0)].h = e.h) or (k + 1 < size(s) and s[least(k + 1, size(s) - 1)].h = e.h)),
    e -> array(e.i, e.i + 1, e.i + 2))))))[0])"""
#: Characters are listed one by one: the JVM then tests a class by one look into a table.
_BLANK = r"\\t\\n\\x0B\\f\\r "
_SIGNS = r"#*$%&|<>"
_UPPER = "".join(chr(c) for c in [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)])
_WORDS = f"""
transform(array(array_remove(split({{text}}, '[{_BLANK}]+'), '')), w -> named_struct(
  'n_words', cast(size(w) as bigint), 'word_chars', cast(length(array_join(w, '')) as bigint), 'n_unique', cast(size(array_distinct(w)) as bigint),
  'n_repeat_words', cast({_REPEATED} as bigint)))[0]"""
_LINES = f"""
transform(array(filter(split({{text}}, '\\n'), x -> x rlike '[^{_BLANK}]')), x -> named_struct('n_lines', cast(size(x) as bigint), 'n_dup_lines', cast(size(x) - size(array_distinct(x)) as bigint)))[0]"""
_MARKS = f"""
transform(array(regexp_replace({{text}}, '[^{_SIGNS}!?0123456789{_UPPER}]+', '')), x -> named_struct(
  'n_symbols', cast(length(regexp_replace(x, '[^{_SIGNS}]+', '')) as bigint), 'n_upper', cast(length(regexp_replace(x, '[^{_UPPER}]+', '')) as bigint),
  'n_digits', cast(length(regexp_replace(x, '[^0123456789]+', '')) as bigint), 'n_shouts', cast(length(regexp_replace(x, '[^!?]+', '')) as bigint)))[0]"""

COUNTS = ("n_words", "word_chars", "n_unique", "n_repeat_words", "n_lines", "n_dup_lines", "n_symbols", "n_upper", "n_digits", "n_shouts")


#: Names of rates(); words is the last.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "word_length", "upper_rate", "digit_rate", "shout_rate", "unique_rate", "line_words", "words")


def with_counts(docs: DataFrame, name: str = "counts") -> DataFrame:
    """Adds one struct column of COUNTS; null text has no words."""
    words, lines, marks = fresh(docs, "w_", "l_", "m_")
    text = "coalesce(text, '')"
    out = docs.withColumns({words: F.expr(_WORDS.format(text=text)), lines: F.expr(_LINES.format(text=text)), marks: F.expr(_MARKS.format(text=text))})
    return out.withColumn(name, F.struct(f"{words}.*", f"{lines}.*", f"{marks}.*")).drop(words, lines, marks)


def rates(counts: str = "counts") -> dict[str, Column]:
    """Length-free features; 0 where the text has no words."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(c(a), c(b)), F.lit(0.0))
    return {
        "symbol_rate": per("n_symbols", "word_chars"), "dup_line_rate": per("n_dup_lines", "n_lines"), "repeat_rate": per("n_repeat_words", "n_words"), "word_length": per("word_chars", "n_words"),
        "upper_rate": per("n_upper", "word_chars"), "digit_rate": per("n_digits", "word_chars"), "shout_rate": per("n_shouts", "n_words"), "unique_rate": per("n_unique", "n_words"), "line_words": per("n_words", "n_lines"), "words": c("n_words"),
    }


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null id: 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0)).cast("int")


def labelled(labels: DataFrame, label: str, folds: Column, bound: int = SAMPLE) -> DataFrame:
    """doc_id, label (0 or 1) of at most about ``bound`` labelled rows of the given folds, chosen by a hash of the id.

    A null id or label is left out; of several labels for one id the largest counts.
    """
    own = labels.where(folds & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    n = own.count()
    return own if n <= bound else own.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(bound / n * (1 << 20)))
