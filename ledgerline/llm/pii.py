"""PII: base patterns, and information-theoretic sanitisation of terms that give them away.

Base spans are found by four patterns over the whole text. A term stands near an entity
(a base value, lower case) if it is among the NEAR terms on either side. The corpus
says how strongly a term reveals an entity: p(e|t) is the number of distinct
surroundings in which the term stands near the entity, over one more than the distinct
texts that hold the term anywhere; log2(p(e|t) / p(e)) bits are disclosed, where p(e)
is the share of the distinct texts that hold the entity. A term with p(e|t) >= SHARE
and BITS or more is removed wherever it stands, as is the base value. So a name that
stands only beside one address goes, a word that other texts use as well stays, and a
template or a copied passage, whose surroundings repeat, discloses nothing.

Everything is DataFrame expressions. Rows that meet by term are only those of candidate
terms, which are few next to the corpus; a text's hash carries the findings back.

Defined results: null text is empty and has no spans; repeated rows get equal spans;
a failing match is dropped and not searched again; an empty table gives no rows; extra
columns stay, those named like a result under another name (underscores in front).
Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, forget, fresh, make_room, table

NEAR, SHARE, BITS = 3, 0.5, 5.0
SIDE = 120  # characters read first on either side of a span; the whole side if they hold fewer than NEAR whole terms
SMALL = 64_000_000  # characters of a table of terms up to which it is broadcast

_D = "0123456789"
_W = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: The base patterns, written so that the JVM's engine neither recurses by length nor tries a start inside a run again.
_EMAIL = rf"(?:(?<![{_W}._%+\\-])|\\G)[{_W}._%+\\-]++@[{_W}\\-]++(?:\\.[{_W}\\-]++)++"
_IP = rf"(?<![{_D}])[{_D}]++\\.[{_D}]++\\.[{_D}]++\\.[{_D}]++"
_CARD = rf"(?<![{_D}])(?<![{_D}][ \\-])[{_D}](?:[ \\-]?[{_D}]){{15,18}}(?![ \\-]?[{_D}])"
_PHONE = rf"\\+[{_D}][ ().{_D}\\-]+[{_D}]"
_HINTS = {"email": "instr({t}, '@') > 0", "ip": rf"{{t}} rlike '[{_D}]\\.[{_D}]+\\.[{_D}]+\\.[{_D}]'", "card": rf"{{t}} rlike '[{_D}](?:[ \\-]?[{_D}]){{{{15}}}}'", "phone": "instr({t}, '+') > 0"}
_TESTS = {
    "email": "true",
    "ip": r"forall(split(e.v, '\\.'), p -> p rlike '^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$')",
    "card": """aggregate(transform(array(regexp_replace(e.v, '[^0-9]+', '')), d -> transform(sequence(1, length(d)), i -> struct(i, cast(substring(d, length(d) - i + 1, 1) as int) as x)))[0], 0,
      (s, p) -> s + if(p.i % 2 = 1, p.x, if(p.x > 4, 2 * p.x - 9, 2 * p.x))) % 10 = 0""",
    "phone": "length(regexp_replace(e.v, '[^0-9]+', '')) between 8 and 15",
}
KINDS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
_NONE = "cast(array() as array<struct<kind: string, s: int, e: int, v: string>>)"
#: What a term ends at: white space and punctuation but hyphen and apostrophe.
_SPLIT = r" \\t\\n\\x0B\\f\\r!\"#$%&()*+,./:;<=>?@\\[\\\\\\]^_`{|}~"


def _found(pattern: str, text: str, kind: str) -> str:
    """All matches with their places: what stands between them is what splitting leaves."""
    return f"""transform(array(struct(regexp_extract_all({text}, '{pattern}', 0) as m, split({text}, '{pattern}', -1) as g)), x ->
      aggregate(zip_with(x.m, slice(x.g, 1, size(x.m)), (m, g) -> struct(m, g)), struct(0 as at, {_NONE} as out),
        (a, p) -> struct(a.at + length(p.g) + length(p.m) as at, array_append(a.out, struct('{kind}' as kind, a.at + length(p.g) as s, a.at + length(p.g) + length(p.m) as e, p.m as v)) as out)).out)[0]"""


def with_base(docs: DataFrame, name: str) -> DataFrame:
    """Adds array<struct<kind, s, e, v>> of the base spans, by kind, then start."""
    text, parts = "coalesce(text, '')", []
    for kind, pattern in KINDS.items():
        parts.append(f"if({_HINTS[kind].format(t=text)}, filter({_found(pattern, text, kind)}, e -> {_TESTS[kind]}), {_NONE})")
    return docs.withColumn(name, F.expr(f"concat({', '.join(parts)})"))


def _terms(text: str, cut: str = "{x}") -> str:
    """Lower-case terms of three characters and more with a letter; ``cut`` takes fragments away."""
    parts = cut.format(x=f"split(lower({text}), '[{_SPLIT}]+')")
    return rf"filter({parts}, w -> length(w) >= 3 and w rlike '\\p{{L}}')"


def _near(side: str, whole: str, cut: str, is_cut: str, order: str) -> str:
    """The NEAR terms next to a span, however far away: of ``side`` if it holds as many without the fragment at its end, else of the ``whole`` side."""
    least = f"transform(array({_terms(side, cut)}), x -> if({is_cut} and size(x) < {NEAR}, {_terms(whole)}, x))[0]"
    return f"slice({order.format(x=f'if({is_cut}, {least}, {_terms(side)})')}, 1, {NEAR})"


def near_terms(docs: DataFrame, base: str) -> DataFrame:
    """h, entity, near: the terms next to each base span."""
    mention = docs.where(F.size(base) > 0).select(F.xxhash64("text").alias("h"), "text", F.explode(base).alias("b"))
    before = _near(f"substring(text, greatest(1, b.s + 1 - {SIDE}), least(b.s, {SIDE}))", "substring(text, 1, b.s)", "slice({x}, 2, 1000000)", f"b.s > {SIDE}", "reverse({x})")
    after = _near(f"substring(text, b.e + 1, {SIDE})", "substring(text, b.e + 1)", "transform(array({x}), y -> slice(y, 1, size(y) - 1))[0]", f"length(text) > b.e + {SIDE}", "{x}")
    return mention.select("h", F.lower("b.v").alias("entity"), F.expr(f"concat({before}, {after})").alias("near"))


def flagged(docs: DataFrame, base: str) -> DataFrame:
    """h, terms: the hash of each text that holds disclosing terms, with those terms."""
    near = near_terms(docs, base)
    near = durable(near.select("h", "entity", F.xxhash64("near").alias("c"), F.array_distinct("near").alias("near")), "mentions")
    pairs = near.select("h", "entity", "c", F.explode("near").alias("term")).distinct()
    # a text with the term near any entity holds it, so a pair whose share is too low even of these texts is out before the corpus is read
    least = pairs.groupBy("term").agg(F.countDistinct("h").alias("least"))
    pairs = pairs.groupBy("entity", "term").agg(F.countDistinct("c").alias("contexts"))
    pairs = durable(pairs.join(least, "term").where(F.col("contexts") / (F.col("least") + 1) >= SHARE).drop("least"), "pairs")
    terms = durable(pairs.select("term").distinct(), "terms")
    held = docs.select(F.xxhash64("text").alias("h"), F.explode(F.expr(f"array_distinct({_terms('text')})")).alias("term"))
    held = durable(held.join(_spread(terms, F.length("term")), "term").distinct(), "held")
    n = docs.where("text is not null").select(F.xxhash64("text")).distinct().count()
    alone = near.groupBy("entity").agg(F.countDistinct("h").alias("texts"))
    every = held.groupBy("term").agg(F.count("*").alias("holding"))
    p = F.col("contexts") / (F.col("holding") + 1)
    bits = F.log2(p * F.lit(float(n)) / F.col("texts"))
    bad = durable(pairs.join(every, "term").join(alone, "entity").where((p >= SHARE) & (bits >= BITS)).select("term").distinct(), "disclosing")
    out = durable(held.join(_spread(bad, F.length("term")), "term").groupBy("h").agg(F.sort_array(F.collect_set("term")).alias("terms")), "flagged")
    forget(near, pairs, terms, held, bad)
    return out


def _spread(few: DataFrame, characters: Column) -> DataFrame:
    """``few`` (durable) with a hint to broadcast it if it is small."""
    size = few.agg(F.count("*"), F.sum(characters)).first()
    return F.broadcast(few) if 50 * size[0] + (size[1] or 0) <= SMALL else few


def with_spans(docs: DataFrame, name: str = "spans_", base: str = "base_") -> DataFrame:
    """Adds the base spans and all spans (base ones, then terms by start)."""
    docs = make_room(docs, name, base)
    x = with_base(docs, base)
    h, terms = fresh(x.withColumn(name, F.lit(0)), "h_", "terms_")
    found = flagged(x, base)
    if found.isEmpty():
        return x.withColumn(name, F.col(base))
    found = _spread(found.withColumnsRenamed({"h": h, "terms": terms}), F.length(F.array_join(F.col(terms), "")))
    x = x.withColumn(h, F.xxhash64("text")).join(found, h, "left")
    quoted = rf"concat('(?iu)(?<![^{_SPLIT}])(?:\\Q', array_join({terms}, '\\E|\\Q'), '\\E)(?![^{_SPLIT}])')"
    spans = _found("", "text", "term").replace("''", quoted)
    free = f"filter({spans}, t -> not exists({base}, b -> t.s < b.e and b.s < t.e))"
    return x.withColumn(name, F.expr(f"if({terms} is null, {base}, concat({base}, {free}))")).drop(h, terms)


def written(spans: str) -> str:
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.s, x.e)), ',')"


def sanitize(docs: DataFrame) -> DataFrame:
    """``docs`` with a mark such as <EMAIL> in place of each span in ``text``; of spans that overlap the first, then the longer, counts."""
    name, base = fresh(docs, "spans_", "base_")
    x = with_spans(docs, name, base)
    order = f"array_sort({name}, (a, b) -> case when a.s <> b.s then a.s - b.s else b.e - a.e end)"
    clean = f"""transform(array(aggregate({order}, struct(0 as at, cast('' as string) as out),
      (a, x) -> if(x.s < a.at, a, struct(x.e as at, concat(a.out, substring(text, a.at + 1, x.s - a.at), '<', upper(x.kind), '>') as out)))), a -> concat(a.out, substring(text, a.at + 1)))[0]"""
    return x.withColumn("text", F.expr(f"if(size({name}) > 0, {clean}, text)")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = {f"n_{k}": F.expr(f"cast(size(filter(base_, b -> b.kind = '{k}')) as bigint)") for k in KINDS}
    return x.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(F.expr(written("base_")), 256).alias("base_sha256"), F.expr(written("spans_")).alias("spans"))
