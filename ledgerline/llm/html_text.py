"""HTML extraction: a site style tree decides which branches of a page are content.

All pages of a host are merged by style: a style node is a path of tags with their
classes. For each style node the corpus says on how many distinct pages of the host it
occurs (m), on how many each of its texts occurs (k), and how the pages vary below it.
A text's content importance is 1 - log k / log m, the share of information that it
still has on this site; a node's presentation importance is the entropy to base m of
the number of blocks that it holds. A block counts by CONTENT and PRESENTATION parts
of the two, and blocks below THRESHOLD leave, which cuts every branch that holds no
other. Pages with one html on a host count once. Nodes on fewer than PAGES pages say
nothing.

Markup that states its role is a prior of the tree: inside an <article> or <main> a
block counts ROLE more, so quotations and reprints stay until they stand on about
half of the site's pages or more; on a page that has one, a block outside of it counts ROLE less
and stays only if the tree knows its node. Where the tree leaves nothing of a page's
article, the article stays. Navigation, footers, asides, forms, scripts, adverts,
notices and comments never stay, since what varies there (comments do on every page)
has a high entropy: there the markup alone decides.

Only counts by host, style node and text are shuffled, so a hot host is spread by its
texts. Defined results: null html gives empty text; a null or odd url belongs to one
nameless host; repeated rows are extracted alike; unclosed, stray and broken tags are
closed as browsers do; an empty table gives no rows; extra columns stay, those named
text or n_chars under another name (underscores in front).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, fresh, make_room, table

PAGES, CONTENT, PRESENTATION, THRESHOLD = 8, 0.9, 0.1, 0.3
ROLE = 0.2  # what markup that states its role adds inside, and takes outside
SMALL = 200_000  # rows of the tree up to which they are broadcast

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>""", re.S)
LABEL = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HOST = re.compile(r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
WORDS = re.compile("[^\\W_]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription comment comments commentlist respond disqus share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead widget login signup search alert toolbar contentinfo complementary".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_HOLDS_P = frozenset({"table", "button", "article", "body", "div", "section", "td", "li"})
ENDS_P = {"": _HOLDS_P} | {t: _HOLDS_P - {t} | {"table", "button"} for t in _HOLDS_P}  # what keeps a block inside from ending a paragraph outside
CLOSING = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in RAW}


class Block:
    """A run of text: a hash of its style path, whether it is inside an article, whether its markup says noise, whether it is inside a list, characters in links."""

    __slots__ = ("path", "inside", "noise", "listed", "text", "linked")

    def __init__(self, path: int, inside: bool, noise: bool, listed: bool, text: str, linked: int):
        self.path, self.inside, self.noise, self.listed, self.text, self.linked = path, inside, noise, listed, text, linked

    @property
    def key(self) -> int:
        return hash_of(f"{self.path}\x00{self.text}")


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(100_000)
def below(path: int, label: str) -> int:
    """The style path of a node below another: a hash, as long as any other however deep."""
    return hash_of(f"{path}/{label}")


class Element(NamedTuple):
    tag: str = ""
    path: int = 0
    inside: bool = False
    noise: bool = False
    listed: bool = False
    link: bool = False


class Stack:
    """The open elements; knows how often each tag is open."""

    def __init__(self) -> None:
        self.own, self.open = [Element()], Counter()

    @property
    def top(self) -> Element:
        return self.own[-1]

    def push(self, e: Element) -> None:
        self.own.append(e)
        self.open[e.tag] += 1

    def pop_to(self, tags: Iterable[str], stop: frozenset[str] | set[str] = frozenset()) -> None:
        """Closes the innermost element with one of the tags, and all in it, unless one of ``stop`` is nearer."""
        if any(self.open[t] for t in tags):
            for k in range(len(self.own) - 1, 0, -1):
                tag = self.own[k].tag
                if tag in tags:
                    for e in self.own[k:]:
                        self.open[e.tag] -= 1
                    del self.own[k:]
                    return
                if tag in stop:
                    return


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    stack, absent = Stack(), set()
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                e = stack.top
                out.append(Block(e.path, e.inside, e.noise, e.listed, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at : m.start() if m else end]
            parts.append(text)
            if stack.top.link:
                linked += len(text)
        if m is None:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if m[1]:
            stack.pop_to((tag,))
            continue
        if tag in RAW:
            close = None if tag in absent else CLOSING[tag].search(page, at)
            if not close:
                absent.add(tag)
            at = close.end() if close else end if tag in ("script", "style", "textarea") else at
            continue
        if tag in VOID:
            continue
        if tag in BLOCK:
            stack.pop_to(("p",), ENDS_P[tag] if tag in ENDS_P else ENDS_P[""])
            if tag in CLOSES:
                stack.pop_to(CLOSES[tag], SCOPE[tag])
        names = [v for a, *vs in LABEL.findall(m[3]) for v in vs if v] if m[3] else []
        up = stack.top
        words = {w for n in names for w in WORDS.findall(n.lower())}
        noise = up.noise or tag in NOISE_TAGS or (tag == "header" and not up.inside) or bool(words & NOISE_WORDS and tag not in ("body", "html", "main", "article"))
        if tag == "article" and words & {"comment", "comments"}:
            noise = True
        inside = up.inside or (tag in ("article", "main") and not noise)
        path = below(up.path, f"{tag}{'.' + '.'.join(sorted(names)) if names else ''}") if tag in BLOCK else up.path
        stack.push(Element(tag, path, inside, noise, up.listed or tag == "li", up.link or tag == "a"))
    flush()
    return out


def main_text(page: str | None, low: frozenset[int] = frozenset(), known: frozenset[int] = frozenset()) -> str:
    """Text of the article: blocks that are neither noise nor of low importance on their site; beside an article only ``known`` ones."""
    if not page:
        return ""
    found = [b for b in blocks(page) if not b.noise]
    inside = [b for b in found if b.inside]
    linked = lambda b: b.linked > 0.8 * len(b.text) and b.listed
    kept = [b for b in found if b.key not in low and (b.inside or ((not inside or b.key in known) and not linked(b)))]
    return "\n".join(b.text for b in (kept if any(b.inside for b in kept) else inside or kept))


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def verdicts(pages: DataFrame) -> DataFrame:
    """page_key, low, known: for each page the keys of its blocks that say too little on their site, and of those beside an article whose node the site knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, url, page in zip(batch["page_key"], batch["url"], batch["html"]):
                host, own = host_of(url), {}
                found = [b for b in blocks(page or "") if not b.noise]
                beside = -1 if any(b.inside for b in found) else 0
                html = hash_of(page or "")
                for b in found:
                    own.setdefault((b.path, 1 if b.inside else beside), []).append(b.key)
                for (path, role), keys in own.items():
                    node = hash_of(f"{host}\x00{path}\x00{role == 1}")
                    out += [(key, html, node, role, len(keys), k) for k in set(keys)]
            yield pd.DataFrame(out, columns=["page_key", "html", "node", "role", "n", "block"])

    x = durable(pages.select("page_key", "url", "html").mapInPandas(run, "page_key long, html long, node long, role int, n int, block long"), "style-tree")
    shapes = x.select("html", "node", "n").distinct().groupBy("node", "n").agg(F.count("*").alias("c"))
    p = F.col("c") / F.col("m")
    nodes = shapes.withColumn("m", F.sum("c").over(Window.partitionBy("node"))).groupBy("node", "m").agg(F.sum(-p * F.log(p)).alias("h")).where(f"m >= {PAGES}")
    texts = x.select("html", "node", "block").distinct().groupBy("node", "block").agg(F.count("*").alias("k"))
    content = 1 - F.log(F.col("k").cast("double")) / F.log(F.col("m").cast("double"))
    shape = F.col("h") / F.log(F.col("m").cast("double"))
    nodes = durable(nodes, "style-nodes")
    score = CONTENT * content + PRESENTATION * shape
    poor = durable(texts.join(spread(nodes), "node").withColumn("score", score).where(F.col("score") < THRESHOLD + ROLE).select("node", "block", "score"), "style-low")
    low = x.join(spread(poor), ["node", "block"]).where(F.col("score") + ROLE * F.col("role") < THRESHOLD).select("page_key", F.col("block").alias("low"), F.lit(None).cast("long").alias("known"))
    known = x.where("role < 0").join(spread(nodes.select("node")), "node", "left_semi").select("page_key", F.lit(None).cast("long").alias("low"), F.col("block").alias("known"))
    return low.unionByName(known).groupBy("page_key").agg(F.sort_array(F.collect_set("low")).alias("low"), F.sort_array(F.collect_set("known")).alias("known"))


def spread(few: DataFrame) -> DataFrame:
    """``few`` (durable) with a hint to broadcast it if it is small, so that a text on very many pages is not one task."""
    return F.broadcast(few) if few.count() <= SMALL else few


def extract(pages: DataFrame) -> DataFrame:
    """Adds text and n_chars to ``pages`` (url, html, ...)."""
    text, n = "text", "n_chars"
    pages = make_room(pages, text, n)
    key, low, known = fresh(pages, "page_key", "low", "known")
    x = pages.withColumn(key, F.xxhash64("url", "html"))
    found = verdicts(x.select(F.col(key).alias("page_key"), "url", "html")).withColumnsRenamed({"page_key": key, "low": low, "known": known})

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, gone, sure in parts:
            yield pd.Series([main_text(h, frozenset() if g is None else frozenset(g), frozenset() if s is None else frozenset(s)) for h, g, s in zip(page, gone, sure)], dtype=object)

    return x.join(found, key, "left").withColumn(text, run("html", low, known)).withColumn(n, F.length(text).cast("long")).drop(key, low, known)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
