"""Shared parts: tables, durable tables in the cluster's folder, word counts, tokenizing."""

from __future__ import annotations

import codecs
import functools
import re
import uuid
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

NOT_WS = r"[^\t\n\x0B\f\r ]+"
WORD = re.compile(NOT_WS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. A local session may leave it unset and gets one below its warehouse; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoint"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files behind ``durable`` tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def n_words(text: Column) -> Column:
    """Number of words; null text: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WS)), F.lit(0)).cast("long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for working columns that do not clash with those of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def make_room(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with its columns that are named like a result under another name: underscores in front."""
    for own in [c for c in df.columns if c.lower() in {r.lower() for r in results}]:
        name = f"_{own}"
        while name.lower() in {c.lower() for c in [*df.columns, *results]}:
            name = f"_{name}"
        df = df.withColumnRenamed(own, name)
    return df


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Unsure(Exception):
    """A part holds white space that could join with more."""


class Parts(dict):
    """Ids, as bytes, of what stands between blanks; a part that is not known is looked up in ``old`` or encoded when it is asked for."""

    LETTERS = re.compile("(\n?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)")
    TAIL = re.compile("(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([^\\w\\s]+)")

    def __init__(self, of: Encoder, old: dict[str, bytes]):
        self.of, self.old = of, old

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._learn(part)
        self[part] = ids
        return ids

    def _learn(self, part: str) -> bytes:
        if part.isascii():  # what most parts are, without patterns
            if part.isalpha():
                return self.of.plain_piece(part)
            if part[:-1].isalpha() and part[-1] in ",.;:!?":
                return self[part[:-1]] + self.of.signs(part[-1])
        if m := self.LETTERS.fullmatch(part):  # one piece, or a line's end and one piece
            return self.of.line_end + self.of.piece(m[2]) if m[1] else self.of.piece(f" {part}")
        if m := self.TAIL.fullmatch(part):  # signs behind letters are a piece of their own
            return self[m[1]] + self.of.signs(m[2])
        if not part.isprintable() or " " in part or not part:  # a line's end at the start is all the white space that may be
            own = part[1:] if part[:1] == "\n" else part
            if not own or len(own.split()) != 1 or own != own.strip():
                raise Unsure
        return self.of.behind(part if part[0] == "\n" else f" {part}")


class Encoder:
    """``tokenizers`` with a bounded memory of the ids of blank-separated parts.

    The pre-tokenizer of this byte-level vocabulary always cuts before a single
    blank between two characters that are not white space, and a single line's end
    between two such characters is a piece of its own. So what stands between is
    encoded by itself and remembered as bytes. Letters go to the library's model at
    once, signs behind letters are a piece of their own, anything else goes to the
    library. A text with an added token's string goes there whole, and a text with
    white space that stands together is cut only at blanks that stand alone.
    """

    LIMIT = 600_000  # parts of a generation; a full one becomes the old one, and what is asked for again moves on
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, limit: int | None = None):
        from tokenizers import Tokenizer

        self.LIMIT = limit or self.LIMIT
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model.tokenize
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others come after 255, in order
        other = iter(range(256, 512))
        self.table = "".join(chr(b if b in plain else next(other)) for b in range(256))
        self.blank = self.table[32]
        self.line_end = self.whole("\n")
        self.signs = functools.lru_cache(10_000)(self.whole)
        self.known, self.wide = Parts(self, {}), {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def behind(self, text: str) -> bytes:
        """Ids of ``text`` (a blank or a line's end comes first) behind a letter."""
        return array("I", self.tok.encode(f"a{text}", add_special_tokens=False).ids[1:]).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole."""
        return array("I", [t.id for t in self.model(codecs.charmap_decode(text.encode(), "strict", self.table)[0])]).tobytes()

    def plain_piece(self, letters: str) -> bytes:
        """Ids of a blank and ASCII letters."""
        return array("I", [t.id for t in self.model(self.blank + letters)]).tobytes()

    def _cut(self, text: str) -> bytes:
        first, *parts = self.CUT.split(text)
        known = self.wide
        if len(known) + len(parts) > self.LIMIT:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = self.behind(f" {p}")
        return self.whole(first) + b"".join(map(known.__getitem__, parts))

    def memory(self) -> Parts:
        if len(self.known) > self.LIMIT:
            self.known.old = {}
            self.known = Parts(self, self.known)
        return self.known

    @staticmethod
    def _odd(first: str) -> bool:
        """Whether what a text begins with is not a part of its own."""
        return not first or first[0].isspace() or first[-1].isspace() or len(first.split()) > 1

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if any(a in text for a in self.added):
            return self.whole(text)
        known = self.memory()
        first, *parts = text.replace("\n", " \n").split(" ")
        if self._odd(first):
            return self._cut(text) if text else b""
        try:
            return self.whole(first) + b"".join(map(known.__getitem__, parts))
        except Unsure:
            return self._cut(text)

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[memoryview, np.ndarray]:
        """Ids of whole texts (null: empty), each with ``end`` behind it, one after the other, and the number of bytes of each.

        Arrow cuts the texts and finds what parts there are, so a part is looked up once for all texts at hand.
        A text that ``encode`` would not take part by part goes there.
        """
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts, n = pc.fill_null(texts, ""), len(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds, found = lists.offsets.to_numpy().astype(np.int64), lists.values.dictionary_encode()
        parts, index, known = found.dictionary.to_pylist(), found.indices.to_numpy().copy(), self.memory()
        values, unsure = list(map(known.get, parts)), []
        for k in [k for k, v in enumerate(values) if v is None]:
            try:
                values[k] = known[parts[k]]
            except Unsure:
                values[k] = b""
                unsure.append(k)
        alone = np.zeros(n, bool)
        for a in self.added:
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if unsure:
            alone[np.searchsorted(bounds, np.flatnonzero(np.isin(index, unsure)), "right") - 1] = True
        begin = bounds[:-1]
        firsts = [parts[k] for k in index[begin].tolist()]
        alone |= np.fromiter(map(self._odd, firsts), bool, n)
        heads = [self.encode(texts[k].as_py()) if own else self.whole(firsts[k]) for k, own in enumerate(alone.tolist())]
        index[np.repeat(alone, np.diff(bounds))] = len(values) + n  # nothing
        index[begin] = len(values) + np.arange(n)
        index = np.insert(index, bounds[1:], len(values) + n + 1)
        ids = pa.array([*values, *heads, b"", end], pa.large_binary()).take(pa.array(index))
        offsets = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1]
        return memoryview(ids.buffers()[2] or b"")[: int(offsets[-1])], np.diff(offsets[bounds + np.arange(n + 1)])


def runs(texts: pa.Array, most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Begin and length of runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    import numpy as np
    import pyarrow.compute as pc

    total, a = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)]), 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, z - a
        a = z


@functools.lru_cache(2)
def encoder(path: str, limit: int | None = None) -> Encoder:
    """One for each Python worker; ``limit`` is that of a generation."""
    return Encoder(path, limit)


def release() -> None:
    """Frees what encoders remember, in a Python worker that goes on with texts of another stage."""
    encoder.cache_clear()
