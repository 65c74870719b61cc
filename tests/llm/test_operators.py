"""Operators against brute force on small fixtures, and their defined cases: nulls, empty and very long texts, ties, repeated
rows, empty tables and columns of clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from filinglens.llm import ann, base, decontamination, html_wrapper, lines, mixing, ngram_join, quality, sharding, token_counts, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def docs(spark, texts, source=None, schema=DOC, extra=()):
    source = source or (lambda i: f"src{i % 3}")
    rows = [(i, t, "en", source(i), len(t or ""), *extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def edge_texts(rng):
    return [None, "", "   \n\n ", "one", "One!", prose(rng, 6000), prose(rng, 40), "x" * 30_000]


def edge_docs(spark, rng):
    """Edge texts, full copies of rows, null ids and sources, and columns that operators might use themselves."""
    texts = edge_texts(rng)
    names = DOC + ", id long, label string, bucket int, score double, epoch int, shard int, slot long, spans string, _q int, size int, rank int"
    rows = [(i, t, "en", None if i == 3 else "s", 1, i, "x", 1, 0.5, 1, 1, 1, "y", 1, 1, 1) for i, t in enumerate(texts)]
    rows += rows[5:7] + [(None, "text without id", None, None, None, *[None] * 11)] * 2
    return spark.createDataFrame(rows, names)


# shared pieces


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in base.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert base.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranked(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, size long").withColumn("u", base.unit_hash(F.col("i").cast("string")))
    out = base.ranked(df, [F.col("g")], F.col("u"), [F.col("u"), F.col("i")], "r", rows="n", size=F.col("size"), running="before", buckets=7).collect()
    for g in ("a", "b", None):
        mine = sorted((r for r in out if r.g == g), key=lambda r: (r.u, r.i))
        assert [r.r for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}
        assert [r.before for r in mine] == [sum(x.size for x in mine[:k]) for k in range(len(mine))]


# 1 lines


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingle(line):
    return {line[i : i + 5] for i in range(len(line) - 4)} if len(line) > 5 else {line}


def test_lines(spark):
    rng = random.Random(5)
    bases = [prose(rng, rng.randint(8, 80)) for _ in range(40)]
    near = [b[:-4] + "zzzz" for b in bases[:30]] + [b.upper() + "  " for b in bases[:10]] + [re.sub(" ", "  ", b) for b in bases[10:15]]
    texts = ["\n".join(rng.sample(bases + near, 5)) for _ in range(60)] + ["hi\nhi\n\nho"]
    got = lines.dedup_lines(docs(spark, texts)).collect()
    norm = lambda s: re.sub(r"\s+", " ", s).lower().strip(" ")
    occurrences = [(i, k, norm(x)) for i, t in enumerate(texts) for k, x in enumerate(t.split("\n")) if norm(x)]
    first = {}
    for i, k, x in occurrences:
        first.setdefault(x, (i, k))
    names = list(first)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [shingle(x) for x in names]
    for a in range(len(names)):
        for b in range(a):
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    head = collections.defaultdict(list)
    for k, x in enumerate(names):
        head[find(k)].append(first[x])
    want = {(i, k): min(head[find(names.index(x))]) for i, k, x in occurrences}
    assert {(r.doc_id, r.line_no): (r.head_id, r.head_line) for r in got} == want
    assert all(r.keep == ((r.doc_id, r.line_no) == (r.head_id, r.head_line)) for r in got)
    kept = lines.without_copies(docs(spark, texts), lines.dedup_lines(docs(spark, texts))).orderBy("doc_id").collect()
    assert sum(len([x for x in r.text.split("\n") if x.strip()]) for r in kept) == sum(r.keep for r in got)


def test_lines_hot_bucket(spark):
    """Many lines that are all near copies stay one component, though their bucket is large."""
    rng = random.Random(6)
    words = [rng.choice(VOCAB) for _ in range(60)]
    texts = [" ".join([*words[:k % 60], f"v{k}", *words[k % 60 + 1:]]) for k in range(200)]
    got = lines.dedup_lines(docs(spark, texts)).collect()
    assert len(got) == 200 and len({(r.head_id, r.head_line) for r in got}) == 1


@pytest.mark.parametrize("size", [100, 160, 320, 640])
def test_lines_recall(spark, size):
    """Lines with single-letter edits down to Jaccard 0.8 find their original, whatever their length."""
    rng = random.Random(size)
    texts = []
    while len(texts) < 1200:
        line = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(size // 9))
        best = other = list(line)
        for i in rng.sample(range(len(line)), len(line)):
            other = [*best]
            other[i] = "#"
            if jaccard(shingle(line), shingle("".join(other))) < 0.8:
                break
            best = other
        texts += [line, "".join(best)]
    got = {r.doc_id: r.head_id for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert sum(got[i] == i - 1 for i in range(1, 1200, 2)) >= 0.99 * 600


def test_lines_template(spark):
    """Pairs just above Jaccard 0.8 among many different lines that share a long passage."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    shared = " ".join(word() for _ in range(36))
    texts = []
    for _ in range(600):
        line = f"{shared} {' '.join(word() for _ in range(6))}"
        near = list(line)
        for i in rng.sample(range(len(line)), len(line)):
            edited = [*near]
            edited[i] = "#"
            if jaccard(shingle(line), shingle("".join(edited))) < 0.8:
                break
            near = edited
        texts += [line, "".join(near)]
    assert all(jaccard(shingle(texts[0]), shingle(x)) < 0.8 for x in texts[2:])
    got = {r.doc_id: r.head_id for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert all(got[i] in (i, i - 1) for i in range(1200)) and all(got[i] == i for i in range(0, 1200, 2))
    assert sum(got[i] == i - 1 for i in range(1, 1200, 2)) >= 0.99 * 600


def test_lines_repeated_characters(spark):
    """Lines that repeat themselves have few distinct shingles: rules and phrases of any length are one."""
    texts = ["-" * 20, "-" * 80, "ha " * 6, "ha " * 60, "=-" * 10, "=-" * 200, "no such line"]
    got = {r.doc_id: r.head_id for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_lines_cases(spark):
    out = lines.dedup_lines(edge_docs(spark, random.Random(1)))
    rows = out.collect()
    assert {r.doc_id for r in rows} == {3, 4, 5, 6, 7, None} and len([r for r in rows if r.keep and r.doc_id == 3]) == 1
    assert lines.dedup_lines(docs(spark, []))._jdf is not None and lines.dedup_lines(docs(spark, [])).count() == 0


# 2 n-gram join


def brute_links(texts):
    sets = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    links = collections.defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                links[a].add(b)
                links[b].add(a)
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, bs in links.items():
            low = min([label[a], *(label[b] for b in bs)])
            if low < label[a]:
                label[a], changed = low, True
    return label, [len(links[i]) for i in range(len(texts))]


def varied(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [256, 8])
def test_ngram_join(spark, small):
    rng = random.Random(7)
    bases = [prose(rng, rng.randint(5, 300)) for _ in range(30)]
    passage = prose(rng, 60)
    texts = bases + [varied(rng, b, rng.randint(0, 6)) for b in bases for _ in range(3)] + [f"{prose(rng, 60)} {passage}" for _ in range(20)] + [varied(rng, bases[0] + " " + prose(random.Random(1), 200), 2) for _ in range(30)] + bases[:5]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.link_classes(docs(spark, texts), small=small).collect()}
    label, links = brute_links(texts)
    assert got == {i: (label[i], links[i]) for i in range(len(texts))}
    kept = ngram_join.keep_first(docs(spark, texts), ngram_join.link_classes(docs(spark, texts), small=small))
    assert {r.doc_id for r in kept.collect()} == set(label)


def test_ngram_cases(spark):
    df = edge_docs(spark, random.Random(1))
    got = ngram_join.link_classes(df)
    rows = got.collect()
    assert len(rows) == df.count()
    by = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert by[3] == by[4] == (3, 1) and by[0] == (0, 0) and by[2] == (2, 0) and by[None] == (None, 0) and by[5] == (5, 0)
    kept = ngram_join.keep_first(df, got)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == sorted([-1, -1, -1, 1, 2, 3, 5, 6, 7])
    assert ngram_join.link_classes(docs(spark, [])).count() == 0


def test_ngram_wordless_files(spark, tmp_path):
    """Files and batches of nothing but null, empty or wordless texts."""
    texts = [None, "", "  ", "?!", "a few words of a text here", "a few words of a text here"]
    df = docs(spark, texts).repartition(6, "doc_id")
    for i in range(len(texts)):
        df.where(F.col("doc_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    got = ngram_join.link_classes(spark.read.parquet(str(tmp_path / "docs"))).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {0: (0, 0), 1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1)}
    assert ngram_join.link_classes(docs(spark, texts[:4])).count() == 4


def test_keep_first_rows_of_one_key(spark):
    """Rows that share a key but differ all stay; full copies of a row don't."""
    rows = [(1, "one", "en", "s", 3), (1, "two", "en", "s", 3), (1, "one", "en", "s", 3), (2, "one", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOC)
    kept = ngram_join.keep_first(df, spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, class_id long, n_links long"))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "one"), (1, "two")]


# 3 nearest neighbours


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")


def brute_neighbours(x, q, k):
    x = np.asarray(x, dtype=np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[q]
    s[q] = -9
    return sorted(range(len(x)), key=lambda i: (-round(s[i], 12), i))[:k]


@pytest.mark.parametrize("leaf", [40, 2000])
def test_neighbours(spark, leaf):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x[100:160] = x[100] + 0.01 * rng.standard_normal((60, 16))  # a crowded direction
    x[200:230] = x[200]  # equal vectors
    df = vectors(spark, x)
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), leaf=leaf).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hits = [len(set(got[q]) & set(brute_neighbours(x, q, 5))) / 5 for q in range(0, 600, 50)]
    assert np.mean(hits) >= 0.9
    assert got[200] == [201, 202, 203, 204, 205] and all(len(v) == 5 for v in got.values())


def test_neighbours_dense_cluster(spark):
    """A third of all vectors lie close together, yet differ: their queries find their own neighbours, too."""
    rng = np.random.default_rng(9)
    middle = rng.standard_normal(32)
    vs = np.vstack([rng.standard_normal((2000, 32)), middle + 0.25 * rng.standard_normal((1000, 32))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vs)], "vec_id long, embedding array<double>")
    u = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    hits = {False: [], True: []}
    got = collections.defaultdict(set)
    for r in ann.neighbours(df, df.where("vec_id % 50 = 0"), leaf=60).collect():
        got[r.query_id].add(r.vec_id)
    for q in range(0, 3000, 50):
        sim = u @ u[q]
        sim[q] = -2
        hits[q >= 2000].append(len(got[q] & set(np.argsort(-sim)[:5].tolist())) / 5)
    assert all(len(x) == 5 for x in got.values()) and np.mean(hits[False]) >= 0.9 and np.mean(hits[True]) >= 0.9


def test_neighbours_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, None, 1), (3, [], 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (8, [1.0, 0.0, 0.0], 1), (0, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.neighbours(df, df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 7, 0.707107), (1, 1, 0, 1.0), (1, 2, 7, 0.707107), (7, 1, 0, 0.707107), (7, 2, 1, 0.707107)]
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_extremes(spark):
    """Components whose squares overflow or vanish, more ties than asked for, and clashing columns."""
    x = [[1e200, 1e200], [1e-200, 1e-200], [2e200, 2e200 * (1 + 1e-9)], [1.0, 0.0]] + [[1.0, 1.0 + 1e-12 * i] for i in range(1, 30)]
    df = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, rank int, score double, id int")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, df).orderBy("query_id", "rank").collect():
        assert r.score <= 1 + 1e-12 and r.score == r.score
        got[r.query_id].append((r.vec_id, r.score))
    assert len(got) == len(x) and all(len(v) == 5 for v in got.values())
    for found in got.values():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))


# 4 mixing


def test_mixing(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(400)]
    df = docs(spark, texts, lambda i: "hot" if i % 2 else f"s{i % 10}")
    sources = {r.source: r.tokens for r in mixing.source_tokens(df).collect()}
    total = sum(sources.values())
    assert total == sum(len(t.split()) for t in texts)
    alpha = mixing.exponent(mixing.source_tokens(df), 0.97, 100.0)
    entropy = lambda a: (lambda w: -sum(x / sum(w) * math.log(x / sum(w)) for x in w))([(t / total) ** a for t in sources.values()])
    goal = 0.97 * math.log(len(sources))
    assert entropy(alpha) >= goal - 1e-4 and entropy(alpha + 1e-4) < goal and alpha < 1
    out = mixing.mix(df, entropy_share=0.97, max_repeats=100.0).collect()
    assert {r.doc_id for r in out} == set(range(400))
    got = collections.Counter()
    for r in out:
        got[r.source] += len(r.text.split())
    raw = {s: (t / total) ** alpha for s, t in sources.items()}
    for s in sources:  # a budget is passed by less than one text
        assert -1 <= got[s] / sum(got.values()) / (raw[s] / sum(raw.values())) - 1 < 0.05
    epochs = collections.defaultdict(set)
    for r in out:
        epochs[r.doc_id].add(r.epoch)
    assert all(e == set(range(len(e))) for e in epochs.values())
    assert mixing.exponent(mixing.source_tokens(df), 1.0, 2.0) > mixing.exponent(mixing.source_tokens(df), 1.0, 100.0)


def test_mixing_cases(spark):
    df = edge_docs(spark, random.Random(1))
    out = mixing.mix(df)
    assert out.columns == [*[c for c in df.columns if c != "epoch"], "epoch"] and out.where("epoch = 0").count() == df.count()
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [None, ""])).count() == 2
    few = mixing.mix(docs(spark, ["a b c d"] * 10, lambda i: "s"), budget=10)
    assert few.count() == 3


# 5 quality


def junk(rng, i):
    t = prose(rng, rng.randint(20, 60))
    return [t.upper().replace(" ", "!! "), " | ".join(t.split()), " ".join(x for w in t.split()[:5] for x in [w] * 12)][i % 3]


def test_quality(spark):
    rng = random.Random(9)
    bad = [rng.random() < 0.2 for _ in range(600)]
    texts = [junk(rng, i) if b else prose(rng, rng.randint(20, 60)).capitalize() + "." for i, b in enumerate(bad)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(not b), 0) for i, b in enumerate(bad) if i % 2 == 0 or i % 5 == 0], "doc_id long, quality int, toxic int")
    rows = quality.classify(df, labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(held) > 80
    assert sum(r.predicted == int(not bad[r.doc_id]) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    again = quality.classify(df.repartition(7), labels.repartition(3)).collect()
    assert {r.doc_id: r.score for r in rows} == {r.doc_id: r.score for r in again}
    model = quality.RuleEnsemble(0.5, [((4, True, 0.3), (1, False, 2.0))], [-1.5])
    assert model.describe() == [(-1.5, "upper > 0.3 AND log_words <= 2")]


def test_tree_rules():
    text = "DT\n  If (feature 3 <= 0.5)\n   If (feature 1 > 2.0)\n    Predict: 0.0\n   Else (feature 1 <= 2.0)\n    Predict: 1.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0\n"
    assert quality.tree_rules(text) == [((3, False, 0.5),), ((1, True, 2.0), (3, False, 0.5)), ((1, False, 2.0), (3, False, 0.5)), ((3, True, 0.5),)]
    assert quality.simplify(((1, True, 1.0), (1, True, 2.0), (1, False, 9.0))) == ((1, False, 9.0), (1, True, 2.0))


def test_quality_cases(spark):
    df = edge_docs(spark, random.Random(1))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(df, none)
    assert out.count() == df.count() and {r.score for r in out.collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(8)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert all(r.score > 0.5 and not r.held_out for r in quality.classify(df, one).where("doc_id IS NULL").collect())
    assert quality.classify(docs(spark, []), none).count() == 0


# 6 decontamination


def brute_contamination(texts, items, window):
    tok = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = tok(t)
        if w and len(w) < window:
            wins[tuple(w)].add(i)
        for k in range(len(w) - window + 1):
            wins[tuple(w[k : k + window])].add(i)
    out = []
    for t in texts:
        w, hit, found = tok(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_contamination(spark, chunk):
    rng = random.Random(10)
    small = ["ab", "cd", "Éf", "gh"]
    items = [(str(i), " ".join(rng.choice(small) for _ in range(rng.choice([0, 2, 3, 4, 6, 7, 9])))) for i in range(25)] + [("n", None), ("3", "zz yy")]
    texts = [" ".join(rng.choice(small) for _ in range(rng.randint(0, 60))).replace("ab cd", "AB, cd!") for _ in range(60)] + [None]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontamination.contamination(docs(spark, texts), bench, window=4, chunk_bytes=chunk).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == brute_contamination(texts, items, 4)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_hit and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_contamination_cut(spark):
    rng = random.Random(11)
    item = prose(rng, 14)
    lead, tail = prose(rng, 30), prose(rng, 12)
    texts = [f"{lead}, {item}. {tail}", item, f"{lead} {tail}", f"{lead} {' '.join(item.split()[:9])} {tail}", None, ""]
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    got = decontamination.contamination(docs(spark, texts), bench, cut=True).orderBy("doc_id").collect()
    assert got[0].text == f"{lead}, . {tail}" and not got[0].drop and got[0].n_hit == 14
    assert got[1].drop and got[1].text == "" and got[1].coverage == 1.0
    assert [r.text for r in got[2:]] == texts[2:] and not any(r.drop for r in got[2:])


def test_contamination_cases(spark):
    df = edge_docs(spark, random.Random(1))
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.contamination(df, none, cut=True)
    assert out.count() == df.count() and out.where("n_hit > 0 OR drop").count() == 0
    assert decontamination.contamination(docs(spark, []), none).count() == 0


# 7 sharding


def test_sharding(spark):
    texts = ["t" * (i % 50) for i in range(997)]
    df = docs(spark, texts, lambda i: "hot" if i % 3 == 0 else f"s{i % 7}")
    rows = sharding.interleave(df, shards=8).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    for source, n in collections.Counter(r.source for r in rows).items():
        per = collections.Counter(r.shard for r in rows if r.source == source)
        # a cut is a common fraction, off by half a row of every source at most, so a source by its share of that
        assert max(abs(per[s] - n / 8) for s in range(8)) <= 1 + n * len({r.source for r in rows}) / len(rows)
    other = sharding.interleave(df.repartition(5), shards=8, buckets=3).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in other}


def test_sharding_cases(spark):
    df = edge_docs(spark, random.Random(1))
    out = sharding.interleave(df)
    assert out.count() == df.count() and len({(r.shard, r.slot) for r in out.collect()}) == df.count()
    assert sharding.interleave(docs(spark, [])).count() == 0


# 8 html


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav>
<div class="ad">buy {i}</div><{main}><h1>Head &lt;{i}&gt;</h1>{body}</{main}><div class="comments"><p>first!</p></div><footer>&copy; {i}</footer></body></html>"""


@pytest.mark.parametrize("main", ["article", 'div id="text"'])
def test_html(spark, main):
    rows = []
    for i in range(30):
        body = "".join(f"<p>Para {i}.{k} &amp; more,\n  <i>spread</i> out.</p>" for k in range(1 + i % 4)) + ("<p><b>bold {i}<br><p>last".replace("{i}", str(i)) if i % 3 == 0 else "")
        page = PAGE.format(nav="".join(f'<li><a href="/{k}">n{k}</a></li>' for k in range(3 + i % 2)), i=i, main=main, body=body).replace(f"</{main}>", f"</{main.split()[0]}>")
        rows.append((i, f"http://h{i % 2}.example.com/{i}", page))
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        want = [f"Head <{i}>"] + [f"Para {i}.{k} & more, spread out." for k in range(1 + i % 4)] + ([f"bold {i}", "last"] if i % 3 == 0 else [])
        assert got[i] == "\n".join(want)


def test_html_mixed_host(spark):
    """A host that marks only some of its articles: the wrapper still serves the pages without marks."""
    page = '<html><body><div class="q1"><a href="/">Start</a> <a href="/x">Section list</a></div><{0}><p>Text {1} of the page, which goes on for a while.</p><p>More {1} of it.</p></{2}><div class="q9">All rights kept</div></body></html>'
    rows = [(i, f"http://one.example.com/{i}", page.format("article", i, "article") if i % 10 else page.format('div class="q5"', i, "div")) for i in range(80)]
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i} of the page, which goes on for a while.\nMore {i} of it." for i in range(80)}


def test_html_rare_template(spark):
    """A host of which few pages have another template, with a menu that no label tells: each template has a wrapper of its own."""
    say = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    menu = "<div class=top><p>Home and all that stays the same on every page of this place</p></div>"
    rows, wants = [], {}
    for i in range(60):
        if i % 20 == 7:
            body = f"{menu}<table class=post><tr><td><div class=entry><p>{say(i, 20)}</p><p>{say(i + 100, 9)}</p></div></td></tr></table>"
        else:
            body = f"{menu}<div class=story><p>{say(i, 20)}</p><p>{say(i + 100, 9)}</p></div>"
        rows.append((i, f"http://one.example.org/{i}", f"<html><body>{body}</body></html>"))
        wants[i] = f"{say(i, 20)}\n{say(i + 100, 9)}"
    got = {r.page_id: r.text for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == wants


def test_wrapper_expression():
    pages = [f"<body><ul>{'<li>x' + str(i) + '</li>' * 1}{'<li>y</li>' * i}</ul><p>a{i}</p>{'<hr>' if i else ''}</body>" for i in range(3)]
    w = html_wrapper.infer(pages)
    assert "(<li> #PCDATA </li>)+" in w.expression and "(<hr> </hr>)?" in w.expression and "<p> #PCDATA </p>" in w.expression
    assert html_wrapper.Wrapper.load(w.dump()).main == w.main == ("body",)


def test_html_labels():
    """Labels of what holds the article, of its header and of inline parts lose nothing."""
    one = lambda page: html_wrapper.extract(page, html_wrapper.Wrapper())
    assert one('<div class="layout with-sidebar"><article><h1>Title</h1><p>Body text</p></article><div class="sidebar">x</div></div>') == "Title\nBody text"
    assert one('<article><div class="article-header"><h1>Title</h1></div><p>Body</p></article>') == "Title\nBody"
    assert one('<article><p>The <span class="share">share</span> price</p><div class="share-box ads">Tell</div></article>') == "The share price"
    assert one('<div class="widget"><div id="c"><p>Only text of the page, which is long.</p></div></div>') == "Only text of the page, which is long."


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<b>x<p>y", "<li>x</li></ul>"])
def test_html_nested(unit):
    """A megabyte of nested elements takes seconds, not hours."""
    start = time.perf_counter()
    out = html_wrapper.extract("<body>" + unit * ((1 << 20) // len(unit)), html_wrapper.Wrapper(("body",)))
    assert out.count("x") == (1 << 20) // len(unit) and time.perf_counter() - start < 30


@pytest.mark.parametrize("unit", ["<b>x", "<div>x", "<div class=a>y<b>x", "<ul><li>x"])
def test_html_nested_inference(unit):
    """The same through the inference of a wrapper, with the text that matters at the bottom."""
    start = time.perf_counter()
    pages = ["<body>" + unit * ((1 << 20) // len(unit)) + f"<section class=q><p>{k} {'deep words ' * 300000}</p></section>" for k in range(2)]
    w = html_wrapper.infer(pages)
    assert w.main[-1] == "section.q" and time.perf_counter() - start < 60
    assert html_wrapper.extract(pages[0], w).startswith("0 deep words")


def test_html_templates():
    """Generated pages of several templates, with and without marks: the article's blocks are what went in."""
    rng = random.Random(21)
    frames = [
        '<body><div class="top"><a href="/">home</a></div><div class="c1"><div class="c2">{}</div></div><div class="foot">All rights</div></body>',
        '<body class="has-sidebar"><nav><ul><li>a</li><li>b</li></ul></nav><main><article>{}</article></main><aside>more</aside></body>',
        '<body><table><tr><td><a href="/x">menu</a></td><td><div id="story">{}</div></td></tr></table><div class="site-footer"><p>c</p></div></body>',
    ]
    for frame in frames:
        pages, wants = [], []
        for _ in range(12):
            blocks = [prose(rng, rng.randint(8, 30)) for _ in range(rng.randint(1, 5))]
            inner = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<ul><li>{b}</li></ul>" for b in blocks[1:])
            pages.append(frame.format(inner))
            wants.append("\n".join(blocks))
        w = html_wrapper.infer(pages[:6])
        assert [html_wrapper.extract(x, w) for x in pages] == wants


def test_html_cases(spark):
    rows = [(1, None, None), (2, "odd url", ""), (3, "http://a", "no tags &amp; < all"), (4, "http://a", "<article>x<!-- c"), (5, None, "<script>only"), (4, "http://a", "<article>x<!-- c"), (None, "http://a", "<p>" * 3000 + "deep")]
    got = html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(((r.page_id or 0), r.text) for r in got.collect()) == [(0, "deep"), (1, ""), (2, ""), (3, "no tags & < all"), (4, "x"), (4, "x"), (5, "")]
    assert html_wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 9 WARC


def page_rows(rng):
    htmls = [None, "", "short", "short", *[f"<p>{prose(rng, 60)}</p>é" for _ in range(30)]]
    htmls += [htmls[10]] * 12 + ["x" * 99] * 2 + ["y" * 100] * 2 + ["z" * 400_000]
    return [(i, None if i % 9 == 0 else f"http://h.example.com/{i} a", h) for i, h in enumerate(htmls)]


def test_warc_round_trip(spark, tmp_path):
    rows = page_rows(random.Random(12))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/one"
    manifest = warc.archive(pages, out, roll_bytes=4000).collect()
    assert len(manifest) > 3 and sum(r.records for r in manifest) == len(rows) and not list((tmp_path / "one").glob(".tmp*"))
    back = {r.page_id: r for r in warc.read_archives(spark, out).collect()}
    first = {}
    for i, url, h in rows:
        raw = (h or "").encode()
        head = first.setdefault(raw, i) if len(raw) >= 100 else i
        r = back[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), hashlib.sha256(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if head == i else ("revisit", head))
        assert r.html == ((h or "") if head == i else None)
    warc.archive(pages.repartition(7), f"file://{tmp_path}/two", roll_bytes=4000)
    one, two = ({p.name: p.read_bytes() for p in (tmp_path / d).glob("*.warc.gz")} for d in ("one", "two"))
    assert one == two


def test_warc_cases(spark, tmp_path):
    schema = "page_id long, url string, html string, span int, salt int"
    long_ = "q" * 200
    rows = [(1, "u", long_, 1, 1), (1, "u", long_, 1, 1), (None, None, long_, 1, 1), (2, "u\r\nX: 1", long_, 1, 1)]
    warc.archive(spark.createDataFrame(rows, schema), f"file://{tmp_path}/a")
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.url) for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect())
    assert got == [(0, "revisit", 1, None), (1, "response", None, "u"), (1, "response", None, "u"), (2, "revisit", 1, "u\r\nX: 1")]
    warc.archive(spark.createDataFrame([], schema), f"file://{tmp_path}/b")
    assert warc.read_archives(spark, f"file://{tmp_path}/b").count() == 0


@pytest.mark.parametrize("n", [1, 3, 700])
def test_warc_spans(spark, n):
    """Cuts follow the bytes: no span holds more than one step and one page, and the search for it finds every page's span."""
    rng = random.Random(n)
    sizes = [(i * 7, rng.choice([1, 10, 500])) for i in range(2000)]
    total = sum(b for _, b in sizes)
    cuts = warc._cuts(spark.createDataFrame(sizes, "page_id long, payload_bytes long"), max(1, total // n))
    assert cuts == sorted(set(cuts)) and len(cuts) <= n
    df = spark.createDataFrame(sizes + [(None, 5)], "page_id long, payload_bytes long").withColumn("span", warc._span(F.col("page_id"), cuts, 16))
    held = collections.Counter()
    for r in df.collect():
        assert r.span == (0 if r.page_id is None else sum(c <= r.page_id for c in cuts))
        held[r.span] += r.payload_bytes
    assert max(held.values()) <= max(1, total // n) + 505


# 10 token counts


def test_token_counts_white_space():
    """Long runs of white space count as the whole text would."""
    enc = token_counts.encoding(token_counts.VOCABULARY)
    old = token_counts._LONG
    texts = ["a" + " " * k + e for k in (1, 5, 40, 300) for e in ("", "b", "\n", " .", "\n\nc", "\x1cd")] + ["\t" * 50 + "x", " " * 90, "x \u3000" * 30]
    try:
        token_counts._LONG = re.compile(old.pattern.replace(str(token_counts.LONG_RUN), "4"))
        assert [token_counts.token_count(enc, t) for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    finally:
        token_counts._LONG = old
    assert token_counts.token_count(enc, " " * 2_000_000 + "word") > 1000 and token_counts.token_count(enc, "e" * 200_000) > 1000



def test_token_counts(spark):
    rng = random.Random(13)
    texts = [*edge_texts(rng), *[prose(rng, rng.randint(1, 400)) for _ in range(60)], "same text", "same text"]
    enc = token_counts.encoding(token_counts.VOCABULARY)
    lengths = [len(enc.encode_ordinary(t)) if t else 0 for t in texts]
    rows = token_counts.context_totals(token_counts.length_histogram(docs(spark, texts)), width=64).collect()
    assert {r.n_tokens: r.n_docs for r in rows} == dict(collections.Counter(lengths))
    for r in rows:
        limit = r.n_tokens
        assert r.docs_upto == sum(x <= limit for x in lengths) and r.docs_over == sum(x > limit for x in lengths)
        assert r.tokens_upto == sum(x for x in lengths if x <= limit) and r.truncated_total == sum(min(x, limit) for x in lengths)
        assert r.lost_tokens == sum(lengths) - r.truncated_total and r.quantile == pytest.approx(r.docs_upto / len(lengths))
    assert token_counts.context_totals(token_counts.length_histogram(docs(spark, []))).count() == 0
