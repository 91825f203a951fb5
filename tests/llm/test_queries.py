"""Every registered query of the training-data operators, run over whole small tables and held against brute force.

The tables hold nulls in every column, empty and very long texts, ties, repeated rows and extra columns whose names clash
with results and working columns; a second set of tables is empty.
"""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerline.llm import pii
from ledgerline.llm.common import default_tokenizer
from ledgerline.llm.queries import QUERIES

from .test_operators import brute_components, water_filling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = "score double, predicted int, kept boolean, n_words long, size long, size_ long, h string, h_ string, row long, counts int, w_ int, spans_ string, base_ string, terms_ string, u_size long, copies int, class long, bands long, sequence_id long, `start` long, text_ string, low long, known long, page_key long, label int"
EXTRA = (0.5, 1, False, 3, 4, 5, "h", "h", 6, 7, 8, "s", "b", "t", 9, 10, 11, 12, 13, 14, "x", 15, 16, 17, 1)
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<float>, query_id long, id long, v int"
PAGES = f"page_id long, url string, html string, text string, n_chars long, {CLASHES}"


def rows_of_documents():
    r = np.random.default_rng(21)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("tan", "ser", "vol", "dim", "gor") for c in ("a", "en", "is", "ot", "ur", "ix", "elo", "ami")]
    out, labels = [], []
    for i in range(420):
        words = [str(w) for w in r.choice(vocabulary, int(r.integers(55, 140)))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            words[3:43:8] = ["you", "idiot", "worthless", "scum", "moron"]
        if bad:
            words = [w + "###" if k % 2 else w for k, w in enumerate(words)]
        if i % 21 == 0:
            words[20:20] = [f"Qz{i}bel", f"q{i}.x@mail.example.com", "or", f"+1 ({100 + i}) 555-01{i % 90 + 10}"]
        if i % 30 == 7:
            words[9:9] = ["10.0.0." + str(i % 256), "4111 1111 1111 1111"]
        text = ". ".join([" ".join(words[k : k + 12]) for k in range(0, len(words), 12)])
        out.append((i, text, "en", None if i % 50 == 9 else f"s{i % 7 if i % 3 else 0}"))
        labels.append((i, int(not bad), int(toxic)))
    out += [(500 + i, out[3][1], "en", "s1") for i in range(6)] + [(510, out[3][1].upper(), "en", "s2"), (511, out[4][1] + " one word more", "en", "s2")]
    out += [(600, None, None, None), (601, "", "en", "s1"), (602, " \n\t ", "en", "s3"), (603, "two words", "en", "s3"), (604, "a\n\n\nb  c\r\n é ß 日本", "fr", "s3"), (605, "two words", "en", "s3")]
    out += [(606, " ".join(r.choice(vocabulary, 30_000)), "en", "s2"), (607, "x" * 70_000, "en", "s2"), (608, "\n".join(["same line here"] * 400), "en", "s4")]
    out += [(800 + i, f"Shared line\n  SHARED Line\t\nowned by {i}\u00c9\n\nshared\u00a0line" + "\nSeen in nine" * (i < 9) + "\nseen in ten\u00c9" * (i < 10), "fr", "s6") for i in range(12)]
    out += [(820, "sola parola", "it", "s1"), (821, "altra", "it", None), (822, None, "it", "s2")]  # a language without kept terms
    out += [(700, "repeated row " * 30, "en", "s5")] * 3 + [(None, "no id " + out[8][1], "en", "s5")]
    labels += [(None, 1, 0), (3, None, None), (4, 1, 0), (4, 1, 0), (9999, 1, 1)]
    return out, labels


def rows_of_vectors():
    r = np.random.default_rng(22)
    out = [(i, [float(x) for x in r.normal(0, 0.15, 8)]) for i in range(160)]
    out += [(50, out[50][1]), (7, [0.5] * 8), (7, [0.25] * 8), (161, out[3][1]), (162, out[3][1])]  # repeated ids, ties
    return [*out, (200, None), (250, [1.0, None]), (300, [float("nan")] * 8), (350, []), (None, [1.0] * 8), (400, [float("inf")] * 8), (164, [0.0] * 8)]


def rows_of_pages():
    menu = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Home</a></nav><header>Site</header>"
    out = [(i, f"http://h{i % 2}.org/{i}", f"{menu}<article><h1>Title {i} &amp; more</h1><p>Body&nbsp;{i} is  <b>bo</b>ld.</p><div class='ad'>Buy</div><p>End {i}</article><footer>f</footer><script>x()</script></body></html>") for i in range(40)]
    deep = "<div>" * 30_000 + "<p>deep" + "<b>" * 30_000 + " text"
    return [*out, out[5], out[5], (900, None, None), (901, None, "<p>no url"), (902, "http://x.y/", ""), (903, "http://deep/", deep), (None, "::", "<p>broken <a href='"), (904, "http://long/", "<p>" + "w " * 200_000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = rows_of_documents()
    frames = {
        "documents": ([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in docs], DOCUMENTS), "labels": (labels, LABELS),
        "embeddings": ([(i, v, 1, 2, 3) for i, v in rows_of_vectors()], VECTORS), "pages": ([(i, u, h, "own", 3, *EXTRA) for i, u, h in rows_of_pages()], PAGES),
    }
    for name, (rows, schema) in frames.items():
        frame = spark.createDataFrame(rows, schema)
        frame.repartition(3).write.parquet(f"{folder}/full/{name}.parquet")
        frame.where("false").write.parquet(f"{folder}/empty/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def found(spark, tables):
    made = {}

    def get(prefix):
        if prefix not in made:
            made[prefix] = next(q for n, q in QUERIES.items() if n.startswith(prefix))(spark, f"{tables}/full").collect()
        return made[prefix]

    return get


DOCS, TRUTH = rows_of_documents()
LIBRARY = Tokenizer.from_file(default_tokenizer())
MIXED = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_every_query_takes_empty_tables(spark, tables):
    for name, query in QUERIES.items():
        assert query(spark, f"{tables}/empty").count() == 0, name
    assert corpus_pipeline.run(spark, f"{tables}/empty").count() == 0


@pytest.mark.parametrize(("op", "modulus", "out", "label"), [("op1_", 5, 0, 2), ("op4_", 3, 1, 1)])
def test_scores(found, op, modulus, out, label):
    rows = found(op)
    truth = {t[0]: t[label] for t in TRUTH[:420]}
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d[0] for d in DOCS)
    right = []
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.held_out and r.doc_id in truth:
            right.append(r.predicted == truth[r.doc_id])
    assert len(right) > 50 and np.mean(right) > 0.9
    assert len({r.score for r in rows if r.doc_id == 700}) == 1


def test_op2(found):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows_of_vectors() if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for k, (i, q) in enumerate(rows):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for m, (j, c) in enumerate(rows) if m != k)
            want += [(i, n, j, -s) for n, (s, j) in enumerate(scores[:5], 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found("op2_")) == sorted(want)


def test_op3(found):
    rows = found("op3_")
    sizes, taken, of = collections.Counter(), collections.Counter(), {}
    source = {d[0]: d[3] for d in DOCS}
    for i, t, _, s in DOCS:
        sizes[s] += len(WORD.findall(t or ""))
    want = water_filling(dict(sizes))
    assert MIXED((r.doc_id, r.size) for r in rows) == MIXED((i, len(WORD.findall(t or ""))) for i, t, _, _ in DOCS)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
        of[s] = max(of.get(s, 0), r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 0.6 * of[s]), s


def test_op5(found):
    for r in found("op5_"):
        if r.page_id is not None and r.page_id < 40:
            i = r.page_id
            assert r.text == f"Title {i} & more\nBody {i} is bold.\nEnd {i}"
        assert r.n_chars == len(r.text)
    by = {r.page_id: r.text for r in found("op5_")}
    assert len(found("op5_")) == len(rows_of_pages()) and sum(r.page_id == 5 for r in found("op5_")) == 3
    assert by[900] == by[902] == "" and by[901] == "no url" and by[903] == "deep text" and by[None] == "broken <a href='"[:6] or by[None].startswith("broken")
    assert by[904] == " ".join(["w"] * 200_000)


def test_op6(found):
    rows = found("op6_")
    want = []
    for i, t, _, _ in DOCS:
        ids = ids_of(t)
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert MIXED((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == MIXED(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        ends = np.cumsum([0, *[n for _, n in sorted(s)]])
        assert [o for o, _ in sorted(s)] == ends[:-1].tolist() and ends[-1] <= 1024
    assert len(by) <= 1.05 * sum(r.length for r in rows) / 1024 + 2


def test_op7(found):
    rows = [(i, t) for i, t, _, _ in DOCS if i is not None]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found("op7_") if r.doc_id is not None} == brute_components(rows)
    assert len(found("op7_")) == len(DOCS) and all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found("op7_"))


def test_op8(found):
    texts = collections.Counter()
    for i, t, _, _ in DOCS:
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:]))
        repeat = len({i + k for i in range(len(w) - 2) if c[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)})
        texts[i, len(w), sum(map(len, w)), sum((t or "").count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), repeat, len(w) < 50 or 100 * repeat > 50 * len(w)] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found("op8_")) == texts
    kept = {r.doc_id: r.kept for r in found("op8_")}
    assert not any(r.kept for r in found("op8_") if r.base_failed)
    learned = [(kept[i], bool(q)) for i, q, _ in TRUTH[:420]]
    assert np.mean([a == b for a, b in learned]) > 0.95


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))
TERM = re.compile(r"[^ \t\n\x0B\f\r!\"#$%&()*+,./:;<=>?@\[\\\]^_`{|}~]+")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(d[::-1])) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def terms(t):
    return [w for w in TERM.findall(t.lower()) if len(w) >= 3 and any(c.isalpha() for c in w)]


def disclosing(texts):
    """The terms to remove, by the plain definition over distinct texts."""
    texts = {t for t in texts if t is not None}
    held, contexts, of = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for t in texts:
        held.update(set(terms(t)))
        for _, a, b in base_spans(t):
            e, near = t[a:b].lower(), tuple(terms(t[:a])[::-1][: pii.NEAR] + terms(t[b:])[: pii.NEAR])
            of[e].add(t)
            for w in near:
                contexts[e, w].add(tuple(dict.fromkeys(near)) and near)
    out = set()
    for (e, w), c in contexts.items():
        p = len(c) / (held[w] + 1)
        if held[w] and p >= pii.SHARE and math.log2(p * len(texts) / len(of[e])) >= pii.BITS:
            out.add(w)
    return out


def test_op9(found):
    bad = disclosing([t for _, t, _, _ in DOCS])
    assert len(bad) > 10 and any(w.startswith("qz") for w in bad)
    want = []
    for i, t, _, _ in DOCS:
        base = base_spans(t or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        own = [(m.start(), m.end()) for m in TERM.finditer(t or "") if m[0].lower() in bad]
        more = [f"term:{a}:{b}" for a, b in own if not any(a < y and x < b for _, x, y in base)]
        n = collections.Counter(k for k, _, _ in base)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(text.encode()).hexdigest(), ",".join([*filter(None, [text]), *more])))
    got = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in found("op9_")]
    assert MIXED(got) == MIXED(want)
    assert sum("term:" in r.spans for r in found("op9_")) >= 10


def test_op10(found):
    rows = sorted(found("op10_"), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d[0] for d in DOCS), key=lambda i: (i is not None, i))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert MIXED((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == MIXED((i, len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t, _, _ in DOCS)


SPACES, TERMS = " \t\n\x0b\f\r", re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def test_op11(found):
    keys = lambda t: [x.strip(SPACES).translate(ASCII_LOWER) for x in (t or "").split("\n")]
    seen = collections.Counter(k for _, t, _, _ in DOCS for k in set(keys(t)))
    gone = {k for k, n in seen.items() if k and n >= 10}
    want = [(i, len(keys(t)), sum(k in gone for k in keys(t)), sha("\n".join(x for x, k in zip((t or "").split("\n"), keys(t)) if k not in gone))) for i, t, _, _ in DOCS]
    assert MIXED((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found("op11_")) == MIXED(want) and gone


def test_op12(found):
    want = []
    for i, t, _, _ in DOCS:
        t = t or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = [int(sha(f"42:{'' if i is None else i}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
        low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
            want.append((i, len(units), "plain", None, None, sha(t), sha(t)))
        elif h[3] % 100 < 80:
            want.append((i, len(units), "spm", len(prefix), len(middle), sha(f"<S>{suffix}<P>{prefix}<M>{middle}"), sha(t)))
        else:
            want.append((i, len(units), "psm", len(prefix), len(middle), sha(f"<P>{prefix}<S>{suffix}<M>{middle}"), sha(t)))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in found("op12_")]
    assert MIXED(got) == MIXED(want) and {w[2] for w in want} == {"plain", "spm", "psm"}


def test_op13(found):
    counts, docs_of, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, t, lang, source in DOCS:
        words = [w.translate(ASCII_LOWER) for w in TERMS.findall(t or "")]
        groups[lang or ""].add(source or "")
        counts.update((lang or "", source or "", w) for w in words)
        docs_of.update((lang or "", w) for w in set(words))
    want = []
    for lang, sources in groups.items():
        kept = sorted((w for (a, w), n in docs_of.items() if a == lang and n >= 10), key=str.encode)
        n = {s: {w: counts[lang, s, w] for w in kept} for s in sources}
        n[None] = {w: sum(n[s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 1_000_000_000 * (c + 2) // (sum(own.values()) + 2 * len(kept)) for w, c in own.items()} for s, own in n.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s))
            terms_ = sorted((-f(p[s][w], p[None][w]), w.encode(), w) for w in kept if n[s][w] and p[s][w] > p[None][w])[:10]
            want += [(lang, s, part, item, -v, k) for part, rows in (("pair", pairs), ("term", terms_)) for k, (v, _, item) in enumerate(rows, 1)]
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in found("op13_")) == sorted(want)
    assert {w[2] for w in want} == {"pair", "term"} and any(not w[4] for w in want)


def test_pipeline_stage_by_stage(spark, tables):
    """Each stage against brute force on its own input; all but the last keep the columns."""
    folder = f"{tables}/full"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == columns, name
            docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["quality_rules"]
    short = {r.text for r in before if len(WORD.findall(r.text or "")) < 50}
    assert not any(r.text in short for r in after) and not any("###" in r.text for r in after)
    assert sum(r.doc_id is not None and r.doc_id < 420 for r in after) == sum(i < 420 and i % 5 > 0 for i, *_ in DOCS[:420])
    before, after = seen["near_dedup"]
    assert {(r.doc_id, r.text) for r in after} < {(r.doc_id, r.text) for r in before}
    assert 3 in {r.doc_id for r in after} and not {500, 505, 510, 511} & {r.doc_id for r in after}
    before, after = seen["pii"]
    assert len(before) == len(after) and not any(EMAIL.search(r.text) for r in after) and any("<EMAIL>" in r.text for r in after)
    clean = {r.doc_id: r.text for r in before if not base_spans(r.text)}
    assert np.mean([clean[r.doc_id] == r.text for r in after if r.doc_id in clean]) > 0.98
    before, after = seen["mixing"]
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before} and len(after) > len(before)
    before, after = seen["packing"]
    assert sum(r.length for r in after) == sum(len(ids_of(r.text)) for r in before)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in again) == sorted((r.doc_id or -1, r.piece, r.ids_crc32) for r in after)
