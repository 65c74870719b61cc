"""One test for each finding of the third round."""

from __future__ import annotations

import random
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filinglens.functions import models
from filinglens.functions import text as t
from filinglens.llm import lines
from filinglens.operators import documents, scoring, sentences, tiers
from filinglens.plans import corpus, scoring_queries, tier_queries

SF = "/root/testdata/sf0.001"


def test_top_sentences_of_equal_sums(spark):
    """0.1 + 0.2 and 0.3 differ in their last bit only: a tie, which sentence order decides."""
    cols = {**{c: F.array().cast("array<string>") for c in scoring.HIT_LISTS}, "growth": F.lit(0.0), "risk": F.lit(0.0), "section": F.lit(""), "text": F.lit("")}
    rows = spark.createDataFrame([(1, 0, 0.3, 0.0), (1, 1, 0.1, 0.2), (1, 2, -0.2, 0.1), (1, 3, 0.4, 0.0)], "doc_id int, sent_id int, net_score double, cost_pressure double")
    rows = rows.withColumns(cols)
    assert [r.sent_id for r in documents.top_sentences(rows).orderBy("rank").collect()] == [3, 0, 1, 2]
    arrays = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sent_id", *[c for c in rows.columns if c not in ("doc_id", "sent_id")]))).alias("scored"))
    top = arrays.select(F.inline(documents.top_of(F.col("scored")))).orderBy("rank")
    assert [r.sent_id for r in top.collect()] == [3, 0, 1, 2]


def _calls(df, name: str) -> int:
    """How often a plan has an expression: one that stands there twice is computed twice a row."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_scores_are_computed_once(spark):
    """Unfolding a computed array, or a filter on what was made of it, used to compute it again."""
    for made in (corpus.scored, scoring_queries.covered, scoring_queries.doc_scores, scoring_queries.tops, scoring_queries.tallies):
        df = made(spark, SF)
        df = df.where("scored > 0") if "scored" in df.columns else df
        assert _calls(df, "regexp_extract_all(") == 1, made.__name__


def test_corpus_row_reads_reports_once(spark):
    df = scoring_queries.g6_corpus_stats(spark, SF)
    assert _calls(df, "regexp_extract_all(") == 1


def test_words_listed_as_stop_and_lexicon(spark):
    """A stop word is no lexicon hit, but still a negation or hedge; a word in two lists is a hit of both."""
    s = scoring.Scorer(growth=["up", "the"], risk=["up", "not"], uncertainty=[], growth_phrases=[], risk_phrases=[], cost_phrases=[], scope_negations=["not"], min_tokens=1)
    f = sentences.Features(stop=["the", "not"], negation=["not"], hedges=["may", "the"])
    docs = spark.createDataFrame([("The UP may not up.",), ("Fine words.",)], "text string")
    array = sentences.sentence_array(F.array(F.struct(F.lit("mdna").alias("section"), F.col("text").alias("body"))))
    for version in ("v1", "v2", "v3"):
        got = docs.select(F.inline(scoring.scored_array(array, s, f, version))).collect()
        rows = sentences.split_sentences(docs.select(F.lit(0).alias("section_ord"), F.lit("mdna").alias("section"), F.col("text").alias("body"), F.col("text").alias("doc_id")), one_section=True)
        want = scoring.score_sentences(sentences.add_features(rows, f), s, version)
        cols = [*scoring.HIT_LISTS, *scoring.SCORES, "net_score", "text"]
        assert sorted(str([r[c] for c in cols]) for r in got) == sorted(str([r[c] for c in cols]) for r in want.collect())
        assert sorted((r.growth_lm, r.risk_lm) for r in got) == [([], []), (["up"], ["up"])]


def test_lemmas_by_join_sends_different_words_once(spark):
    """A row's words meet the dictionary once each, however often it has them, and rows of one key keep their own words."""
    table = spark.createDataFrame([("cats", "cat"), ("cats", "cut"), ("dogs", "dog")], "form string, lemma string")
    df = spark.createDataFrame([(1, ["cats", "cats", "the", "dogs"] * 50), (1, ["dogs"]), (2, ["the"]), (3, [])], "id int, words array<string>")
    got = sorted((r.id, r.lemma) for r in models.lemmas_by_join(df, table, ["id"]).collect())
    assert got == [(1, ["cat", "cat", "the", "dog"] * 50), (1, ["dog"]), (2, ["the"])]
    known = {r.id: r.known for r in models.known_forms(df, table, ["id"]).collect()}
    assert known == {1: {"cats": "cat", "dogs": "dog"}}


ROWS = [
    (1, "mdna", "with the plan is the growth as from here on the way. This was not for risk in the end, it may be so! As it was with with from?"),
    (2, "qa_A_0", "Nothing to be found here, for words are few and none counts. a b"), (3, "risk_factors", ""), (4, "x", None), (5, "mdna", "Ærø was in the north;  for this are many.\nAt last. \t Done with it all, is the end near?"),
]


@pytest.mark.parametrize("version", ["v1", "v2", "v3"])
@pytest.mark.parametrize("kind", ["short", "long", "many", "lemma", "stopped"])
def test_scored_rows_are_those_of_the_array(spark, version, kind):
    scorer, features = corpus.SCORER, corpus.FEATURES
    if kind == "long":
        scorer = replace(scorer, growth=[*scorer.growth, *(f"w{i}" for i in range(20))], risk_phrases=[*scorer.risk_phrases, *(f"p {i}" for i in range(20))])
    if kind == "many":
        scorer = replace(scorer, growth_phrases=[*scorer.growth_phrases, *(f"p {i}" for i in range(70))])
    if kind == "lemma":
        features = replace(features, lemma=lambda w: F.transform(w, lambda x: F.when(x == "many", F.lit("with")).otherwise(x)))
    if kind == "stopped":
        features = replace(features, stop=["with", "was"])
    docs = spark.createDataFrame(ROWS, "doc_id long, section string, body string")
    flat = scoring.scored_rows(sentences.split_sentences(docs, one_section=True), scorer, features, version)
    array = scoring.scored_array(sentences.sentence_array(F.array(F.struct("section", "body"))), scorer, features, version)
    whole = docs.select("doc_id", F.inline(array))
    got, wanted = (sorted(tuple(map(repr, r)) for r in df.select(whole.columns).collect()) for df in (flat, whole))
    assert got == wanted and len(got) >= 4


def test_sentences_are_scored_in_generated_code(spark):
    plan = corpus.scored(spark, SF)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not [x for x in plan if "lambdafunction" in x and ("regexp_extract_all" in x or "net_score" in x)]
    assert any("regexp_extract_all" in x for x in plan)


def test_sentence_ends(spark):
    texts = ["a.  b", "a. . b", ".\n!\t? x", " .a", ". ", "a .", "é.  b. c", "", "..  ..\n\n", "a!\r\n\r\nB? ", "\U0001F600. x"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert all(r[0] == r[1] for r in df.select(t.sentences(F.col("t")), F.split("t", r"(?<=[.!?])\s+", -1)).collect())


def test_response_lines_are_cut_once(spark):
    m = spark.createDataFrame([(1, 0, 1), (1, 0, 2)], "doc_id int, batch int, n int")
    r = spark.createDataFrame([(1, 0, " 1 | Positive|x|y\n\n2|odd|z\n2| neutral | w\n1|a")], "doc_id int, batch int, response_text string")
    out = tiers.parse_responses(m, r, ["doc_id", "batch"])
    assert _calls(out, r"split(line#") == 1
    assert sorted((x.n, x.label, x.reason) for x in out.collect()) == [(1, "positive", "x"), (2, "neutral", "w")]


def test_answers_number_the_pending_once(spark):
    """Each step that joined the pending sentences used to sort and number them again, and carried their texts."""
    rows = tier_queries.routed(spark, SF)
    m, r = tier_queries.answers(rows)
    assert "text" not in rows.columns
    out = tiers.api_error_fallback(m, tiers.parse_responses(m, r, tier_queries.KEYS), r.where("doc_id % 3 = 0"), tier_queries.KEYS)
    assert _calls(out, "row_number(") == 0


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and ".data" in n}


def test_steps_of_line_dedup_leave_no_shuffle_files(spark):
    """They used to stay until the driver collected its garbage, and took more disk than the tables between the steps."""
    before = _shuffle_files(spark)
    out = lines.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    assert not _shuffle_files(spark) - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert out.where("keep").count() == out.select("head_id", "head_line").distinct().count()


def test_hashes_are_those_of_the_shingles(spark):
    """A regular expression used to begin one in the midst of a character beyond 16 bits."""
    odd = ["a", "abcde", "abcdef", "-" * 80, "ha " * 40, "x😀y" * 9, "größe und maß " * 3, "你好世界你好世界你", "the quick brown fox jumps over the lazy dog"]
    rows = spark.createDataFrame([(t,) for t in odd], "norm string").select("norm", F.size(lines._hashes("norm")).alias("n"))
    assert {r.norm: r.n for r in rows.collect()} == {t: len({t[i : i + 5] for i in range(max(1, len(t) - 4))}) for t in odd}


@pytest.mark.parametrize("many", [0, 99])
def test_links_with_and_without_bitmaps(spark, monkeypatch, many):
    """Bitmaps decide what is computed, never what is found."""
    monkeypatch.setattr(lines, "MANY", many)
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefgh ", k=200)) for _ in range(6)]
    texts += [t[:k] + "Z" + t[k + 1 :] + "!" * (k // 9) for t in texts for k in (3, 50, 99, 140, 180)]
    rows = spark.createDataFrame([(i, i, 1000 + i, t) for i, t in enumerate(texts)], "node long, k1 long, k2 long, norm string")
    pairs = rows.select(F.col("node").alias("a")).crossJoin(rows.select(F.col("node").alias("b"))).where("a < b")
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in lines._links(pairs, rows, rows, 0.8).collect()} == want and 20 < len(want) < len(texts) ** 2 / 4


@pytest.mark.parametrize("pattern", [corpus.PATTERN, t.TOKEN])
@pytest.mark.parametrize("kind", ["short", "long", "lemma", "stopped", "none"])
def test_hit_rows_are_those_of_scored_rows(spark, kind, pattern):
    scorer, features = corpus.SCORER, replace(corpus.FEATURES, pattern=pattern)
    if kind == "long":
        scorer = replace(scorer, growth=[*scorer.growth, *(f"w{i}" for i in range(20))])
    if kind == "lemma":
        features = replace(features, lemma=lambda w: F.transform(w, lambda x: F.when(x == "many", F.lit("with")).otherwise(x)))
    if kind == "stopped":
        features = replace(features, stop=["with", "was"])
    if kind == "none":
        scorer = replace(scorer, growth=[], risk=[], uncertainty=[], growth_phrases=[], risk_phrases=[], cost_phrases=[])
    more = [(6, "mdna", "Withers wasp Bees farewell thisis! One two three four. One two three four five. a-b-c-d be. ...... ?! --- Ünder wäs ÄRE Are élan fromé."), (7, "x", "  ")]
    docs = spark.createDataFrame([*ROWS, *more], "doc_id long, section string, body string")
    sents = sentences.split_sentences(docs, one_section=True)
    for version in ("v1", "v2"):
        want = scoring.scored_rows(sents, scorer, features, version).select("doc_id", "sent_id", scoring.has_hit().alias("any_hit"))
        got = scoring.hit_rows(sents, scorer, features, version).select("doc_id", "sent_id", "any_hit")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() >= 4


def test_coverage_makes_no_hit_lists(spark):
    plan = scoring_queries.f2_coverage(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "sort_array" not in plan


def test_line_dedup_gives_back_the_disk_of_its_steps(spark, monkeypatch):
    """Tables between the steps used to stay, each bucket of theirs in as many files as tasks wrote it."""
    written, real = [], lines.clustered
    monkeypatch.setattr(lines, "clustered", lambda df, *keys, **how: written.append((keys, real(df, *keys, **how))) or written[-1][1])
    seen, gone = {}, lines.emptied
    monkeypatch.setattr(lines, "emptied", lambda *tables: [seen.update({f: t for f in t.inputFiles()}) for t in tables] and gone(*tables))
    out = lines.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    (keys, texts), (by, rows) = written
    assert keys == ("k1", "k2") and by == ("bucket",) and len([f for f in seen if seen[f] is rows]) <= 4
    assert len({f.rsplit("/", 1)[0] for f in seen}) == 4 and not any(Path(f.removeprefix("file:").replace("///", "/")).exists() for f in seen)
    assert out.where("keep").count() == out.select("head_id", "head_line").distinct().count() and texts.count() > 0


def test_small_and_large_buckets_find_the_same(spark, monkeypatch):
    """All pairs of small buckets at once, or the most frequent line first: components are the same."""
    rng = random.Random(7)
    texts = []
    for _ in range(30):
        base = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(20))
        texts += [base] + [base[:k] + "#" + base[k + 1 :] for k in rng.sample(range(len(base)), 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = []
    for small in (1, 8):
        monkeypatch.setattr(lines, "SMALL", small)
        got.append({r.doc_id: r.head_id for r in lines.dedup_lines(docs).collect()})
    assert got[0] == got[1] == {i: i // 4 * 4 for i in range(120)}
