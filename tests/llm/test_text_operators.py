"""Fill-in-middle, source divergence and byte-level BPE against brute force, and their defined cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from filinglens.llm import bpe, divergence, fim
from filinglens.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
CLASHING = ", n int, form string, output string, ids int, decoded string, row int, t string, h int, cut int"


@pytest.fixture(scope="module")
def oracle():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks(Path(VOCABULARY).read_bytes())
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    return bpe.compile_merges(bpe.read_vocabulary(VOCABULARY))


# 11 fill-in-middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fim(key, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if key is None else key}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb\r\n", "é\n日本\n𝒳\n\nz", "has <P> in it\n", "<S>", "x<M", "<\n<P\n<S\n<M\nS>\n", " \n \n", "q" * 200_000,
    "line of text\n" * 20_000, " a\x0bb\x85c\nd",
]


@pytest.mark.parametrize("percent", [100, 40])
def test_fim(spark, percent):
    rng = random.Random(5)
    texts = FIM_TEXTS + ["".join(rng.choice("ab<PSM>\n é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a\nb\nc\n"), (None, None), (4, "one"), (4, "one")]
    out = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent, spm_percent=30)
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *brute_fim(i, t, percent, 30)) for i, t in rows), key=key)
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t in rows)
    if percent == 100:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_other_units(spark):
    """Words as units, and columns that have the names of those added."""
    df = spark.createDataFrame([(1, "ab  cd ef ", 9, "f", "o", 1, "d", 2, "t", 3, 4)], "doc_id long, text string" + CLASHING)
    out = fim.fill_in_middle(df, unit=r"\s*\S+|\s+").first()
    assert out.n == 4 and out.ids == 1 and out.t == "t" and out.row == 2 and out.form in ("psm", "spm")
    assert fim.fill_in_middle(df.limit(0)).collect() == []


# 12 divergence


def brute_divergence(rows, least=3, top=200):
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {k[0] for k in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        sources = sorted((s for k, s in groups if k == lang), key=lambda s: s.encode())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(groups[lang, s]) for s in sources}
        q = share(sum((groups[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in sources if o != s]
            single = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", single, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, r) for r, (i, v) in enumerate(found[:limit], 1)}
    return out


def divergence_rows(rng, n):
    words = [f"{a}{b}" for a in "abcdéßдю𝒳z" for b in ("", "q", "xy", "ü", "zz")]
    for _ in range(n):
        weights = [1 / (k + 1) for k in range(len(words))]
        text = " ".join(rng.choices(words, weights, k=rng.randint(0, 30))) + rng.choice(["", " A1B2 c", "\n\tDon't É Ü"])
        yield rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "𝒳", "￿", None, ""]), text


@pytest.mark.parametrize(("cells", "held"), [(1 << 18, 300_000), (40, 20)])
def test_divergence(spark, monkeypatch, cells, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = list(divergence_rows(random.Random(3), 400))
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    got = divergence.divergence(df, top=20, cells=cells).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute_divergence(rows, top=20)


def test_divergence_cases(spark):
    """Nulls, groups without terms, languages of one source or without kept terms, long texts, repeated rows, clashing columns."""
    rows = [("en", "a", None), ("en", "b", ""), ("en", "c", "123 --"), ("de", "only", "ein wort"), ("de", "only", "ein wort"), ("de", "only", "ein wort")]
    rows += [("fr", "x", "mot " * 400_000), ("fr", "y", "mot autre"), ("fr", "y", "mot autre"), ("fr", "y", "Mot autre " + "w" * 100_000), (None, None, None), ("es", "a", "uno"), ("es", None, "dos")]
    df = spark.createDataFrame([(*r, 1, "v", 2, 3, "term") for r in rows], "lang string, source string, text string, n int, value string, rank int, block int, term string")
    assert {tuple(r) for r in divergence.divergence(df).collect()} == brute_divergence(rows)
    assert divergence.divergence(df.limit(0)).collect() == []


def test_divergence_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = "aa bb2cc éé " + "z" * 30 + " dd  É"
    assert [t for p in divergence.terms(text) for t in p] == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def test_shares_beyond_64_bits():
    assert divergence.shares([10**13, 0, -1], 10**14, 7).tolist() == [1 + 10**9 * (10**13 + 1) // (10**14 + 7), 1, 1]


def test_segment_trees_share_nodes():
    """Equal runs of counts are one node, and the walk of two trees meets every term once."""
    counts = np.array([[5, 1] + [0] * 998, [0] * 500 + [1] * 500, list(range(1000))])
    trees = divergence.SegmentTrees(counts)
    assert sum(len(left) for left, _ in trees.levels) < 2 * 1024 + 60
    for g, h in ((0, 1), (1, 2), (2, 2)):
        x, y, times = trees.leaf_pairs(g, h)
        met = {(trees.leaves[a], trees.leaves[b]): n for a, b, n in zip(x, y, times)}
        assert met == {**collections.Counter(zip(counts[g].tolist(), counts[h].tolist())), (-1, -1): 24}


# 13 byte-level BPE


@pytest.mark.parametrize("steps", [bpe.MAX_STEPS, 20])
def test_bpe_random(oracle, merges, monkeypatch, steps):
    """Characters of all kinds, also with a bound on steps so small that they are forgotten all the time."""
    monkeypatch.setattr(bpe, "MAX_STEPS", steps)
    rng = random.Random(1)
    own = bpe.Encoder(merges, PATTERN)
    alphabets = ["abcdefghijklmnopqrstuvwxyz ", "aab ", "éàüñç ñlos ", "日本語の文字", "0123456789.,$% ", " \t\n\r\u00a0\u2003", "'sdtremvl ", "😀👍🏽\u200d", "{}[]();=<>/\\\"_-"]
    for _ in range(1500):
        alphabet = rng.choice([*alphabets, "".join(alphabets)])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert own.encode(text).tolist() == oracle.encode_ordinary(text)


def test_bpe_code_points(oracle, merges):
    """Every code point beside letters, numbers, spaces and marks: those assigned later are in no class."""
    own = bpe.Encoder(merges, PATTERN)
    points = [chr(c) for c in range(0x3400) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3400, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    points += [c for c in map(chr, range(0xA000, 0x34000)) if own.later.search(c)]
    for c in points:
        text = f"a{c}b{c}1{c} {c}{c}a !{c}  {c} a"
        assert own.encode(text).tolist() == oracle.encode_ordinary(text), hex(ord(c))


def test_bpe_long(oracle, merges, monkeypatch):
    """Long pieces in linear time, long texts in steps, steps and pieces forgotten on the way."""
    monkeypatch.setattr(bpe, "TEXT_STEP", 1000)
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    monkeypatch.setattr(bpe, "MAX_PIECES", 20)
    own = bpe.Encoder(merges, PATTERN)
    rng = random.Random(8)
    for text in ("x" * 50_000, "ab" * 30_000, "".join(rng.choice("abcdefg") for _ in range(20_000)), " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(5000))):
        assert own.encode(text).tolist() == oracle.encode_ordinary(text)
    assert own.encode(" " * 300_000 + "a").tolist()[-1:] == oracle.encode_ordinary(" a")


def test_bpe_unreached_tokens():
    """A token that merges never reach stands for a piece that equals it, and nowhere else."""
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cab": 259, b"bcd": 260, b"abcd": 261, b"dd": 262, b"ddd": 263, b"dddd": 264, b"xyz": 265}
    want = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    own = bpe.Transducer(bpe.compile_merges(ranks))
    assert own.merges.unreached == {b"xyz"}
    rng = random.Random(2)
    for text in ["xyz", "axyz", "xyzxyz", *("".join(rng.choice("abcdxyz") for _ in range(rng.randint(1, 14))) for _ in range(3000))]:
        assert own.encode(text.encode()) == want.encode_ordinary(text)


def test_stream_decoder():
    """A character's bytes may come in different ids; what is no UTF-8 is replaced."""
    tokens = bpe.token_array({i: bytes([i]) for i in range(256)} | {300: b"zz"})
    ids = lambda data: pa.array(list(data), pa.int32())
    text = "aé日😀z"
    machine = bpe.StreamDecoder(tokens)
    assert "".join(machine.feed(ids([b])) for b in text.encode()) + machine.feed(ids([300, 97])[:1], True) == text + "zz"
    machine = bpe.StreamDecoder(tokens)
    assert machine.feed(ids([0x61, 0xFF, 0xE6])) + machine.feed(ids([0x97]), True) == b"a\xff\xe6\x97".decode("utf-8", "replace")
    with pytest.raises((ValueError, IndexError)):
        machine.feed(ids([299]))


def test_bpe_cases(spark, oracle, monkeypatch):
    texts = [None, "", " ", "\x00", "one", "One! 'tis <|endoftext|>", "naïve café 日本語 😀", "x" * 100_000, " \n" * 5000, "\U00010ee7a \U00018cd6b"]
    df = spark.createDataFrame([(i, t, 1, "f", "o", 1, "d", 2, "t", 3, 4) for i, t in enumerate(texts)] * 2, "doc_id long, text string" + CLASHING)
    coded = bpe.encode(df, VOCABULARY, PATTERN)
    got = bpe.decode(coded, VOCABULARY).collect()
    assert len(got) == 2 * len(texts) and all(r.t == "t" and r.row == 2 for r in got)
    for r in got:
        assert r.ids == oracle.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    assert bpe.encode(df.limit(0), VOCABULARY, PATTERN).collect() == []
    monkeypatch.setattr(bpe, "ID_STEP", 3)  # characters end in other steps than they begin in
    assert {r.decoded for r in bpe.decode(coded, VOCABULARY).collect()} == {t or "" for t in texts}
    assert bpe.decode(spark.createDataFrame([(1, None)], "a int, ids array<int>"), VOCABULARY).first().decoded == ""


def test_bpe_query(spark, oracle):
    """The registered query against the library, row by row."""
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = oracle.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(r.text or "")))
    assert {tuple(r) for r in QUERIES["op13_byte_bpe"](spark, SF).collect()} == want


def test_html_long_units_and_alignment():
    """Units of any length fold, and sequences of any length are aligned on common terms in order, by one rule at every size."""
    from filinglens.llm import html_wrapper as hw

    row = "<tr>" + "".join(f"<td class=c{c}>x</td>" for c in "abcdefghijklmnopqrst") + "</tr>"
    expression = hw.infer([f"<table>{row * 50}</table>"]).expression
    assert expression.count("<td.") == 20 and ")+" in expression
    rng = random.Random(3)
    for n, kinds in ((0, 3), (30, 3), (300, 5), (300, 1000), (5000, 40)):
        a = [rng.randrange(kinds) for _ in range(n)]
        b = [x for x in a if rng.random() < 0.9] + [rng.randrange(kinds) for _ in range(n // 10)]
        pairs = hw.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert hw.common(a, a) == [(i, i) for i in range(n)]
    # what each side has once is met, wherever the rest moves
    assert hw.common([1, 2, 2, 3, 9], [1, 7, 2, 3, 8]) == [(0, 0), (2, 2), (3, 3)]
    # an inserted block is one optional group, the rest stays
    once = "<body><h1>a</h1><p>b</p></body>"
    more = "<body><h1>c</h1><div><i>d</i></div><p>e</p></body>"
    assert hw.infer([once, more]).expression.count(")?") == 1
