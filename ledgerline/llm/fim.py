"""Fill-in-middle transformation: a two-pass streaming matcher in constant memory.

A text is cut into units (a word with the white space before it, or the white space at
the end). The first pass counts the matches; from that number and a hash of the id come
two ranks; the second pass advances a lazy match iterator to the lower rank, then on to
the higher one, and stops there. No array of units exists at any time, so a text of any
length costs its own characters and nothing more. What is between is written with
sentinels as suffix-prefix-middle or prefix-suffix-middle; ``restored`` is the inverse
as Spark expressions.

Every row stands alone: there is no shuffle, so no key can be hot.

Defined results: null text is empty; an empty text, one that holds a sentinel and one
that the hash leaves out stay plain (no prefix or middle, null lengths); a null id is
hashed as an empty string; repeated rows get equal results; white space alone is one
unit; very long texts are cut whole; an empty table gives no rows; extra columns stay,
those that are named like a result under another name (underscores in front).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, make_room, table

SEED, RATE, SPM = 42, 50, 80  # percent of the texts that are transformed; of these, percent in the order suffix, prefix, middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
RESULT = "n long, form string, output string, prefix_chars long, middle_chars long"


def count(text: str) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in UNIT.finditer(text))


def ends(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units ``low`` and ``high`` end (low <= high; 0 units end at 0)."""
    units = UNIT.finditer(text)
    first = next(itertools.islice(units, low - 1, None)).end() if low else 0
    second = next(itertools.islice(units, high - low - 1, None)).end() if high > low else first
    return first, second


def transformed(text: str, digest: str, rate: int = RATE, spm: int = SPM) -> tuple[int, str, str, int | None, int | None]:
    """The fields of RESULT for one text; ``digest`` is the hash in hexadecimal digits."""
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = count(text)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", text, None, None
    a, b = ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", a, b - a
    return n, "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", a, b - a


def transform(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with n (units), form (plain, spm or psm), output (the transformed text), prefix_chars and middle_chars."""
    docs = make_room(docs, "n", "form", "output", "prefix_chars", "middle_chars")

    @F.pandas_udf(RESULT)
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, digests in batches:
            out = pd.DataFrame([transformed(t, d, rate, spm) for t, d in zip(texts, digests, strict=True)], columns=["n", "form", "output", "prefix_chars", "middle_chars"])
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = fresh(docs, "fim_")[0]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return docs.withColumn(made, cut(F.coalesce(F.col(text), F.lit("")), digest)).select(*docs.columns, f"{made}.*")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of ``transform``, rebuilt from output and form alone."""
    p, s, m, size = F.instr(output, PREFIX), F.instr(output, SUFFIX), F.instr(output, MIDDLE), len(PREFIX)
    part = lambda a, b: F.substring(output, a + size, b - a - size)
    middle = F.substring(output, m + size, F.length(output))
    return F.when(form == "spm", F.concat(part(p, m), middle, part(s, p))).when(form == "psm", F.concat(part(p, s), middle, part(s, m))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    hashed = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *[F.sha2(c, 256).alias(k) for k, c in hashed.items()])


ORACLE = r"""
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
u as (select *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as units, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
  cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from t),
c as (select *, len(units) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as lo, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as hi,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, coalesce(array_to_string(units[1:lo], ''), '') as prefix, coalesce(array_to_string(units[lo + 1:hi], ''), '') as middle, coalesce(array_to_string(units[hi + 1:n], ''), '') as suffix from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'spm' then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
  sha256(case form when 'plain' then text else prefix || middle || suffix end) as restored_sha256
from p
"""
