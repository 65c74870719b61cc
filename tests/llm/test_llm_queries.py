"""Registered queries of the operators against their SQL, and the pipeline stage by stage, on the smallest tables."""

from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from filinglens.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are missing")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows, cols: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=repr)
    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pipeline"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_neighbours_query(spark):
    """The registered search against all cosines: exact scores, order and ties, recall of 0.9 at least."""
    import numpy as np

    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and (v != 0).any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v / np.linalg.norm(v) for _, v in rows])
    got: dict[int, list] = {}
    for r in QUERIES["op3_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    found = 0
    for k in np.flatnonzero(ids % 50 == 0):
        cosine = x @ x[k]
        mine = sorted(got[int(ids[k])])
        assert [r for r, _, _ in mine] == list(range(1, 6)) and [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        place = {int(i): c for i, c in zip(ids, cosine)}
        assert all(i != ids[k] and abs(place[i] - s) < 1e-9 for _, i, s in mine)
        best = sorted((-c, i) for i, c in place.items() if i != ids[k])[:5]
        found += len({i for _, i in best} & {i for _, i, _ in mine})
    assert found >= 0.9 * 5 * len(got)


def test_token_counts_query(spark):
    """The registered totals against every document's length by the library."""
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    from filinglens.llm.token_counts import PATTERN, VOCABULARY

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(own.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.n_tokens: r for r in QUERIES["op10_token_counts"](spark, SF).collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        upto = [x for x in lengths if x <= n]
        assert (r.n_docs, r.docs_upto, r.docs_over, r.tokens_upto) == (lengths.count(n), len(upto), len(lengths) - len(upto), sum(upto))
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.lost_tokens == sum(lengths) - r.truncated_total
        assert r.quantile == len(upto) / len(lengths)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.columns[: len(columns)] == columns and (k == 4 or out.columns == columns)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] <= sizes[4] == sizes[5]
    items = [tuple(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w[i : i + 10] for w in items for i in range(len(w) - 9)}
    for r in docs.collect():
        w = tuple(re.findall(r"[^\W_]+", r.text.lower()))
        assert not any(w[i : i + 10] in windows for i in range(len(w) - 9))


DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, epoch int, drop string, n_words long, shard string, _rest int, id int"


def tables(spark, tmp_path, rows, items=(), labels=()):
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def stages(spark, tmp_path, sf):
    """The rows after every stage, written and read again between them."""
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(docs.collect())
    return seen


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and columns that have operators' names."""
    more = (0.5, 7, "d", 9, "s", 1, 2)
    words = " ".join(f"w{i}" for i in range(40))
    passage = " ".join(f"b{i}" for i in range(12))
    texts = [None, "", "  ", "one", words, words, f"{words} more", f"x {passage} " + " ".join(f"y{i}" for i in range(30)), passage, " ".join(f"l{i}" for i in range(30_000)), "q" * 100_000]
    rows = [(i, t, "en", None if i == 3 else "s", None if t is None else len(t), *more) for i, t in enumerate(texts)]
    rows += [rows[9], (None, "text without id", None, None, None, *[None] * 7), (None, "text without id", None, None, None, *[None] * 7)]
    quality, near, clean, mixed, sharded = stages(spark, tmp_path, tables(spark, tmp_path, rows, [(1, passage), (2, None)]))
    key = lambda rs: sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rs))
    assert key(quality) == sorted((i is None, i or 0, t or "") for i, t, *_ in rows)  # no labels: nothing is rejected
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == [0, 1, 2, 3, 4, 7, 8, 9, 10] and sum(r.doc_id is None for r in near) == 2
    left = {r.doc_id: r for r in clean}
    assert set(left) == {None, 0, 1, 2, 3, 4, 7, 9, 10} and "b3" not in left[7].text and left[7].n_chars == len(left[7].text) and left[9].text == texts[9]
    assert all((r.score, r.epoch, r["drop"], r.n_words, r.shard, r["_rest"], r["id"]) == more for r in clean if r.doc_id is not None)
    assert {r.doc_id for r in mixed} == set(left) and len(mixed) >= len(clean)
    assert len(sharded) == len(mixed) and len({(r.shard, r.slot) for r in sharded}) == len(mixed)


def test_pipeline_empty(spark, tmp_path):
    assert [len(x) for x in stages(spark, tmp_path, tables(spark, tmp_path, []))] == [0] * 5


def test_near_duplicate_stage(spark, tmp_path):
    """The stage keeps the smallest doc_id of every brute-force class of the documents of the smallest table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {}
    for i, r in rows.items():
        w = re.findall(r"\w+", r.text.lower())
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if k else set()
    label = {i: i for i in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == set(label.values()) and all(r == rows[r.doc_id] for r in kept)
