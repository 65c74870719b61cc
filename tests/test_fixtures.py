"""Small literal fixtures with expected values."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from filinglens import dictionaries as d
from filinglens.functions import models
from filinglens.functions import text as t
from filinglens.operators import baseline, cleaning, documents, evaluation, logistic, preparation, scoring, sentences, tiers
from filinglens.sources import records
from filinglens.streaming import incremental

#: The companies of the baseline fixture.
SECTORS = {"Technology": ["AAPL", "MSFT", "GOOGL", "META"], "Financials": ["JPM", "BAC", "WFC", "GS"]}


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_cleaner(spark):
    raw = (
        "Page 3 of 47\nUNITED STATES SECURITIES AND EXCHANGE COMMISSION\nWashington, D.C. 20549\n“strong” growth us-gaap:Revenues ........ 12\n\n\n\nend ."
    )
    got = one(spark, raw, t.clean_text)
    for gone in ("Page 3 of 47", "SECURITIES", "“", "us-gaap", "....", "\n\n\n", " ."):
        assert gone not in got
    assert '"strong" growth' in got and got.endswith("end.")
    assert one(spark, None, t.clean_text) == ""
    assert one(spark, "&#8220;A&#8221; &amp; ﬁn", lambda c: t.clean_text(t.decode_text(c))) == '"A" & fin'


def test_strip_html(spark):
    assert one(spark, "<p>A &amp; B</p>\n<b>C</b>", lambda c: t.strip_html(c, None)) == "A   B C"
    assert one(spark, "<p>short</p>", t.strip_html) is None


@pytest.mark.parametrize(("raw", "want"), [
    ("2024-11-01", "2024-11-01"), ("November 1, 2024", "2024-11-01"), ("Nov 1, 2024", "2024-11-01"), ("11/01/2024", "2024-11-01"),
    ("2024-11-01T12:00:00", "2024-11-01"), (" soon ", "soon"),
])
def test_dates(spark, raw, want):
    assert one(spark, raw, t.normalize_date) == want


def test_call_details(spark):
    df = spark.createDataFrame([("Apple (AAPL) q3 2024 Call", "AAPL"), ("A.B+C call", "A.B+C"), ("Nothing", "ZZ")], "title string, ticker string")
    got = [tuple(r)[2:] for r in preparation.call_details(df).collect()]
    assert got == [("Q3", "2024", "Apple"), ("", "", "A.B+C"), ("", "", "ZZ")]


TEN_K = """Item 1. Business
See Item 7: of this report.
Item 1A. Risk Factors
Supply chain disruptions could hurt. As described in Item 7: under our plan.
Item 7. Management's Discussion and Analysis
We had strong performance. We expect growth next year. Costs fell.
Item 7A. Quantitative disclosures
None
Item 8. Financial Statements
See index to consolidated statements."""


def test_report_sections(spark):
    df = spark.createDataFrame([(1, "10-K", TEN_K), (2, "8-K", "Item 7. Management's Discussion and Analysis\nAll will be kept."), (3, "10-Q", "no header")], "doc_id long, form_type string, text string")
    got = {(r.doc_id, r.section): r.body for r in cleaning.report_sections(df).collect()}
    assert "strong performance" in got[1, "mdna"] and "See index" not in got[1, "mdna"]
    assert "Supply chain disruptions" in got[1, "risk_factors"] and "under our plan" in got[1, "risk_factors"]
    assert got[1, "forward_guidance"] == "We expect growth next year."
    assert got[2, "mdna"].startswith("Item 7") and (2, "risk_factors") not in got
    assert got[3, "mdna"] == "no header"
    heads = [(r.number, r.title) for r in cleaning.item_headers(df.where("doc_id = 1")).orderBy("pos").collect()]
    assert [n for n, _ in heads] == ["1", "1A", "7", "7A", "8"]


ONE_LINE = (
    "Front Item 1A. Risk Factors Supply may fail" + " and fail again" * 9 + ". See Item 7: of this report" + " for more" * 16 + ". Item 7. Management's Discussion and Analysis Our revenue rose strongly in "
    "the year because demand for devices will expand in many regions and costs fell. Margins grew. " + "Item 8. Statements " + "x" * 130 + " none."
)


def test_report_on_one_line(spark):
    """Nothing between the first header and the end of a text is lost, wherever its lines end."""
    rows = [(1, "10-K", ONE_LINE), (2, " 10-k ", ONE_LINE), (3, "10-K", "As described above, see Item 7: of the report. We expect more."), (4, "10-Q", None), (5, "10-K", "Item 7. Management's Discussion and Analysis\u0001 kept")]
    df = spark.createDataFrame(rows, "doc_id long, form_type string, text string")
    got = {(r.doc_id, r.section): r.body for r in cleaning.report_sections(df).collect()}
    mdna = got[1, "mdna"]
    assert mdna.startswith("Item 7. Management's Discussion and Analysis Our revenue rose") and mdna.endswith("Margins grew.")
    assert got[1, "risk_factors"] == ONE_LINE[ONE_LINE.index("Item 1A") : ONE_LINE.index(" Item 7. Man")]
    assert "demand for devices will expand" in got[1, "forward_guidance"] and got[2, "mdna"] == mdna
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, "forward_guidance"): "We expect more."}
    assert not [k for k in got if k[0] == 4] and got[5, "mdna"].endswith("kept")
    heads = cleaning.item_headers(df.where("doc_id = 1")).orderBy("pos").collect()
    assert " ".join(r.body for r in heads) == ONE_LINE.removeprefix("Front ") and [r.number for r in heads] == ["1A", "7", "8"]
    assert "Exchange" not in cleaning.route_by_form(df)._jdf.queryExecution().executedPlan().toString()


CALL = """Tim Cook -- Chief Executive Officer
Welcome all.
Questions and Answers
Amit Daryanani -- Evercore ISI -- Analyst
How is demand?
Tim Cook -- Chief Executive Officer
Strong demand -- although we remain cautious.
Wamsi Mohan -- Bank of America -- Analyst
And margins?
Luca Maestri -- Chief Financial Officer
Good."""


def test_transcript(spark):
    df = spark.createDataFrame([(1, CALL), (2, "Only remarks.")], "doc_id long, text string")
    got = [(r.section, r.body) for r in cleaning.transcript_sections(df.where("doc_id = 1")).orderBy("section_ord").collect()]
    assert [s for s, _ in got] == ["prepared_remarks", "qa_Q_0", "qa_A_1", "qa_Q_2", "qa_A_3"]
    assert "Amit Daryanani" not in got[0][1] and "although" in got[2][1]
    _, qa = cleaning.split_transcript(F.col("text"))
    turns = cleaning.parse_turns(df.select("doc_id", qa.alias("qa_body"))).orderBy("turn_idx").collect()
    assert [x.title for x in turns] == ["Evercore ISI -- Analyst", "Chief Executive Officer", "Bank of America -- Analyst", "Chief Financial Officer"]
    assert cleaning.transcript_sections(df.where("doc_id = 2")).collect()[0].body == "Only remarks."
    both = cleaning.route_by_form(df.withColumn("form_type", F.lit("EARNINGS_CALL")).unionByName(spark.createDataFrame([(3, TEN_K, "10-K")], "doc_id long, text string, form_type string")))
    assert {r.doc_id for r in both.collect()} == {1, 2, 3}


def bodies(spark, rows):
    return spark.createDataFrame([(i, 0, s, x) for i, (s, x) in enumerate(rows)], "doc_id long, section_ord int, section string, body string")


def feats(spark, rows, **how):
    return sentences.add_features(sentences.split_sentences(bodies(spark, rows)), sentences.Features(**how))


def test_flags(spark):
    rows = feats(spark, [("mdna", "We may grow a lot. We saw demand rise. We did not see weakness.")]).orderBy("sent_id").collect()
    assert [r.has_negation for r in rows] == [False, False, True]
    assert [r.has_hedge for r in rows] == [True, False, False]
    stats = sentences.preprocess_stats(feats(spark, [("mdna", "One two. Not three.")])).first()
    assert (stats.n_sentences, stats.n_negated, stats.sentences_by_section) == (2, 1, {"mdna": 2})


@pytest.mark.parametrize(("section", "neg", "hedge", "version", "want"), [
    ("mdna", False, False, "v1", 5.0), ("forward_guidance", False, True, "v1", 3.0), ("mdna", True, False, "v1", -5.0), ("mdna", True, False, "v2", 0.0),
])
def test_scores(spark, section, neg, hedge, version, want):
    df = feats(spark, [(section, "We saw strong demand and raised guidance")]).withColumns({"has_negation": F.lit(neg), "has_hedge": F.lit(hedge)})
    assert scoring.score_sentences(df, scoring.Scorer(growth=["strong"]), version).first().growth == pytest.approx(want)


@pytest.mark.parametrize(("text", "kept"), [
    ("the company which was not previously struggling reported strong revenue growth", False),
    ("it is not a b c d e strong gain here", True),
    ("strong demand not here today folks", True),
])
def test_scope(spark, text, kept):
    lexicon = ["strong"] if "demand" not in text else []
    got = scoring.score_sentences(feats(spark, [("mdna", text)]), scoring.Scorer(growth=lexicon), "v3").first()
    assert got.has_negation and (got.growth != 0.0) is kept


def test_negation_against_python(spark):
    rng = random.Random(3)
    vocab = ["not", "up", "down", "x", "y", "z", "the"]
    rows = [("mdna", " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 14)))) for _ in range(120)]
    s = scoring.Scorer(growth=["up"], risk=["down"], growth_phrases=["y z"], risk_phrases=["z y"], cost_phrases=["x x"])
    f = feats(spark, rows, stop=["the"])
    got = {v: {r.doc_id: (r.growth, r.risk, r.cost_pressure) for r in scoring.score_sentences(f, s, v).collect()} for v in ("v1", "v2", "v3")}
    for i, (_, text) in enumerate(rows):
        w = text.split()
        g_l, r_l = int("up" in w), int("down" in w)
        g_p, r_p, k_p = int("y z" in text), int("z y" in text), int("x x" in text)
        g, r, k, neg = g_l + 2.0 * g_p, r_l + 2.0 * r_p, 2.0 * k_p, "not" in w
        near = lambda word: any(abs(a - b) <= 5 for a, x in enumerate(w) if x == "not" for b, y in enumerate(w) if y == word)  # noqa: B023, E731
        assert got["v1"][i] == pytest.approx((-g, -r, -k) if neg else (g, r, k))
        assert got["v2"][i] == pytest.approx((0.0 if g else g, 0.0 if r else r, 0.0) if neg else (g, r, k))
        assert got["v3"][i] == pytest.approx((0.0 if near("up") else g, 0.0 if near("down") else r, 0.0) if neg else (g, r, k))


def random_bodies(rng, n):
    vocab = ["not", "no", "up", "Down", "x", "y", "z", "the", "may", "naïve", "Über", "up.", "down!", "y z", "\n"]
    return [(rng.choice(["mdna", "risk_factors", "qa_A_3", "qa_Q_1"]), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80)))) for _ in range(n)]


@pytest.mark.parametrize("version", ["v1", "v2", "v3"])
def test_scores_inside_the_row(spark, version):
    """Arrays of sentences give the same sentences, scores, tops and tallies as tables of them, without a shuffle."""
    rng = random.Random(9)
    s = scoring.Scorer(growth=["up", "über", "y"], risk=["down", *(f"w{i}" for i in range(40))], uncertainty=["naïve"], growth_phrases=["y z"], risk_phrases=["z y", "x x"], cost_phrases=["x y"])
    f = sentences.Features(stop=["the", "y"])
    two = [(i, 2 * i + j, j, sec, x) for i in range(60) for j, (sec, x) in enumerate(random_bodies(rng, 2))]
    sections = spark.createDataFrame([(i, j, sec, x) for i, _, j, sec, x in two], "doc_id long, section_ord int, section string, body string")
    rows = scoring.score_sentences(sentences.add_features(sentences.split_sentences(sections), f), s, version)
    docs = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_ord", "section", "body"))).alias("sections"))
    docs = spark.createDataFrame(docs.collect(), docs.schema)  # the arrays as they come from a source
    arrays = docs.select("doc_id", scoring.scored_array(sentences.sentence_array(F.col("sections")), s, f, version).alias("scored"))
    cols = ["doc_id", "sent_id", "section", "text", *scoring.HIT_LISTS, *scoring.SCORES, "net_score"]
    by_key = lambda df, *keys: sorted((tuple(r) for r in df.select(*keys).collect()), key=repr)
    assert by_key(arrays.select("doc_id", F.inline("scored")), *cols) == by_key(rows, *cols)
    x = F.col("scored")
    flat = arrays.select("doc_id", documents.scores_of(x).alias("s")).select("doc_id", "s.*")
    assert by_key(flat, *flat.columns) == by_key(documents.document_scores(rows, docs.select("doc_id")), *flat.columns)
    top = arrays.select("doc_id", F.inline(documents.top_of(x, 3)))
    assert by_key(top, *top.columns) == by_key(documents.top_sentences(rows, 3), *top.columns)
    tally = arrays.select("doc_id", F.inline(documents.tally_of(x, 2)))
    assert by_key(tally, *tally.columns) == by_key(documents.tally_terms(rows, 2), *tally.columns)
    stats = docs.select("doc_id", sentences.stats_of(sentences.sentence_array(F.col("sections")), f).alias("s")).select("doc_id", "s.*").where("n_sentences > 0")
    other = sentences.preprocess_stats(sentences.add_features(sentences.split_sentences(sections), f))
    flat_map = lambda df: df.withColumn("sentences_by_section", F.map_entries("sentences_by_section"))
    assert by_key(flat_map(stats), *stats.columns) == by_key(flat_map(other), *stats.columns)
    cover = arrays.select("doc_id", documents.coverage_of(x).alias("c")).select("doc_id", "c.*").where("scored > 0")
    assert by_key(cover, *cover.columns) == by_key(documents.coverage(rows), *cover.columns)
    for df in (flat, top, tally, stats, documents.analyses(arrays)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_scores_without_sentences(spark):
    docs = spark.createDataFrame([(1, []), (2, [("mdna", "")]), (3, [("mdna", None)])], "doc_id long, sections array<struct<section: string, body: string>>")
    arrays = docs.select("doc_id", scoring.scored_array(sentences.sentence_array(F.col("sections")), scoring.Scorer()).alias("scored"))
    got = documents.analyses(arrays).collect()
    assert [(tuple(r.scores), tuple(r.coverage), r.tallies, r.top_sentences) for r in got] == [((0.0,) * 4, (0, 0), [], [])] * 3


def test_model_is_loaded_once_a_worker(spark, tmp_path):
    """However many batches and tasks a worker runs. Nulls reach the model."""
    import os

    import pyarrow as pa

    folder = str(tmp_path)

    def load():
        with open(f"{folder}/loads", "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: pa.array([[] if x is None else x.split() for x in texts.to_pylist()], pa.list_(pa.string()))

    words = models.model_column(load, "array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for _ in range(2):
            df = spark.range(400, numPartitions=8).select(F.when(F.col("id") % 5 != 0, F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"))
            assert df.select(F.sum(F.size(words(F.col("text")))).alias("n")).first().n == 640
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    loads = (tmp_path / "loads").read_text().split()
    assert len(loads) == len(set(loads)) <= 8
    nouns = sentences.add_features(spark.createDataFrame([("An old Tree",)], "text string"), nouns=words).first()
    assert nouns.noun_phrases == ["An", "old", "Tree"]


def test_lemmas(spark):
    table = spark.createDataFrame([("was", "be"), ("were", "be"), ("cités", "cité"), ("gains", "gain"), ("gains", "gainz"), (None, "x"), ("y", None)], "form string, lemma string")
    df = spark.createDataFrame([(1, ["gains", "were", "up", "gains"]), (2, []), (3, ["cités", "y"])], "id int, words array<string>")
    want = {1: ["gain", "be", "up", "gain"], 2: [], 3: ["cité", "y"]}
    lemma = models.lemma_column(table)
    assert {r.id: r.l for r in df.select("id", lemma(F.col("words")).alias("l")).collect()} == want
    assert {r.id: r.lemma for r in models.lemmas_by_join(df, table, ["id"]).collect()} == {k: v for k, v in want.items() if v}
    assert models.lemma_column(table, max_forms=3) is None
    rows = feats(spark, [("mdna", "The gains were not small")], lemma=lemma).collect()
    assert rows[0].lemma == ["the", "gain", "be", "not", "small"] and sorted(rows[0].terms) == ["gain", "not", "small"]  # "were" is a stop word, so is its lemma
    got = scoring.score_sentences(feats(spark, [("mdna", "The gains went up a lot")], lemma=lemma), scoring.Scorer(growth=["gain"])).first()
    assert got.growth_lm == ["gain"] and got.growth == 1.0


def test_many_phrases(spark):
    """An automaton finds what a look for each phrase finds, also out of several automata."""
    rng = random.Random(6)
    phrases = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(700)})
    texts = ["".join(rng.choice("abcé  ") for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    for most in (1 << 20, 200):
        found = models.phrase_column(phrases, most)
        assert {r.i: r.p for r in df.select("i", found(F.col("text")).alias("p")).collect()} == {i: sorted(p for p in phrases if x is not None and p in x) for i, x in enumerate(texts)}
    s = scoring.Scorer(growth_phrases=phrases[:300], risk_phrases=phrases[200:], cost_phrases=["zz", "é"])
    few = scoring.hit_columns(feats(spark, [("mdna", x) for x in texts if x]), s).orderBy("doc_id", "sent_id").collect()
    for r in few:
        low = r.text.lower()
        assert r.growth_phrases == [p for p in phrases[:300] if p in low] and r.risk_phrases == [p for p in phrases[200:] if p in low] and r.cost_phrases == [p for p in ("zz", "é") if p in low]


def test_unicode_tokens(spark):
    got = one(spark, "Das Café Straße, naïve—été", t.forms)
    assert got == ["das", "café", "straße", ",", "naïve", "—", "été"]


def test_uncertainty_survives(spark):
    s = scoring.Scorer(uncertainty=["maybe"])
    got = scoring.score_sentences(feats(spark, [("mdna", "this is not maybe so sure")]), s, "v2").first()
    assert got.risk == pytest.approx(0.5)


MOCK = {
    "Technology": {"AAPL": (0.20, 0.30), "MSFT": (0.15, 0.28), "GOOGL": (0.10, 0.25), "META": (0.05, 0.35)},
    "Financials": {"JPM": (0.08, 0.40), "BAC": (0.06, 0.45), "WFC": (0.10, 0.42), "GS": (0.05, 0.48)},
}


def mock(spark):
    rows = [(t_, g, r) for ts in MOCK.values() for t_, (g, r) in ts.items()]
    return baseline.sector_for(spark.createDataFrame(rows, "ticker string, growth double, risk double"), d.sector_table(spark, SECTORS))


def test_baseline(spark):
    got = {r.reference: r for r in baseline.baseline_stats(mock(spark)).collect()}
    want = {"Technology": (0.125, 0.0645, 0.295, 0.042), "Financials": (0.0725, 0.0222, 0.4375, 0.035), "_corpus_all": (0.0988, 0.0528, 0.3663, 0.0842)}
    for k, v in want.items():
        r = got[k]
        assert (r.growth_mean, r.growth_stdev, r.risk_mean, r.risk_stdev) == pytest.approx(v, abs=1.01e-4)
    few = baseline.baseline_stats(mock(spark).where("ticker IN ('AAPL', 'MSFT')")).where("reference = 'Technology'").first()
    assert not few.reliable
    single = baseline.baseline_stats(mock(spark).where("ticker = 'AAPL'")).first()
    assert single.growth_stdev == 1.0


def test_zscores(spark):
    b = baseline.baseline_stats(mock(spark))
    docs = mock(spark).unionByName(spark.createDataFrame([("ZZZZ", 0.18, 0.29, "Unknown")], "ticker string, growth double, risk double, sector string"))
    docs = docs.withColumn("engine_version", F.lit("v1"))
    got = {r.ticker: r for r in baseline.apply_zscores(docs, b).collect()}
    for k, v in {"AAPL": (1.163, 0.119, 1.044), "JPM": (0.338, -1.071, 1.409), "META": (-1.163, 1.310, -2.472), "ZZZZ": (1.538, -0.906, 2.444)}.items():
        assert (got[k].z_growth, got[k].z_risk, got[k].z_net) == pytest.approx(v, abs=3e-3)
    assert got["ZZZZ"].reference == "_corpus_all" and not got["ZZZZ"].is_sector_specific
    none = baseline.apply_zscores(docs, b.limit(0)).first()
    assert none.reference == "no_baseline" and none.z_growth == 0.0
    with pytest.raises(ValueError):
        baseline.baseline_universe(docs, d.sector_table(spark, SECTORS), ["Nowhere"])
    assert min(r.n for r in baseline.sector_coverage(d.sector_table(spark, SECTORS)).collect()) >= 4


def test_responses(spark):
    members = spark.createDataFrame([(1, 0, n, f"s{n}") for n in (1, 2, 3)], "doc_id long, batch int, n int, text string")
    text = spark.createDataFrame([(1, 0, "1|positive|x\n3|bad|y\n2|NEGATIVE|z")], "doc_id long, batch int, response_text string")
    got = {r.n: (r.label, r.reason) for r in tiers.parse_responses(members, text, ["doc_id", "batch"]).collect()}
    assert got == {1: ("positive", "x"), 2: ("negative", "z"), 3: ("neutral", "parse_error")}
    scored = spark.createDataFrame([(1, 0, "1|positive|1.7|a\n2|odd|-0.4|b")], "doc_id long, batch int, response_text string")
    got = {r.n: (r.label, r.net_score, r.growth, r.risk) for r in tiers.parse_scored_responses(members, scored, ["doc_id", "batch"]).collect()}
    assert got[1] == ("positive", 1.0, 1.0, 0.0) and got[2] == ("neutral", -0.4, 0.0, 0.4)


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (-4.0, -3.9, 0.0, 10.0, 11.0)], "net_score double")
    got = {r.bin: r.n for r in documents.net_histogram(df).collect()}
    assert got == {"<= -4": 1, "-4 to -2": 1, "-2 to 0": 1, "0 to 2": 0, "2 to 4": 0, ">= 4": 1}


def fit_alone(x, y, c, classes=3):
    """The same objective by plain gradient steps, in numpy."""
    import numpy as np

    n, k = len(x), classes
    one = np.hstack([x, np.ones((n, 1))])
    w, free = np.zeros((k, one.shape[1])), np.ones(one.shape[1])
    free[-1] = 0.0
    speed = 1.0 / (0.5 * np.linalg.eigvalsh(one.T @ one / n)[-1] + 1 / (c * n))
    ahead, momentum = w, 1.0
    for _ in range(6000):
        z = one @ ahead.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        new = ahead - speed * (p.T @ one / n + ahead * free / (c * n))
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return w


def centred(w):
    """Weights up to what the same shift of all classes' intercepts changes."""
    w = w.copy()
    w[:, -1] -= w[:, -1].mean()
    return w


def class_rows(rng, n):
    rows = [(i, [rng.gauss(1.2 * (i % 3 == k), 1.0) for k in range(4)], i % 3, d.LABELS[i % 3]) for i in range(n)]
    return rows, "id long, vector array<double>, label_id int, true_label string"


def test_penalties_in_one_pass(spark):
    """Every model equals an independent fit, and Spark's own, to 1e-3; the best C is the brute-force one."""
    import numpy as np

    rows, schema = class_rows(random.Random(1), 300)
    df = spark.createDataFrame(rows, schema).repartition(3)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    got = logistic.fit_penalties(df, d.C_GRID)
    for c, w in zip(d.C_GRID, got, strict=True):
        assert np.abs(centred(w) - centred(fit_alone(x, y, c))).max() < 1e-3
        model = tiers.train_classifier(df, c)
        assert np.abs(centred(np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])) - centred(w)).max() < 2e-3
    split = evaluation.stratified_split(df)
    train, val = (split.where(f"split = '{s}'").orderBy("id").collect() for s in ("train", "val"))
    best, table = evaluation.tune_c(split.where("split = 'train'"), split.where("split = 'val'"))
    want = []
    for c in d.C_GRID:
        w = fit_alone(np.array([r.vector for r in train]), np.array([r.label_id for r in train]), c)
        said = (np.hstack([np.array([r.vector for r in val]), np.ones((len(val), 1))]) @ w.T).argmax(axis=1)
        f1 = []
        for k in range(3):
            hit = sum(1 for r, s in zip(val, said) if r.label_id == k == s)
            f1.append(2 * hit / max(1, sum(r.label_id == k for r in val) + sum(s == k for s in said)))
        want.append((c, round(sum(f1) / 3, 4)))
    assert [tuple(r) for r in table.orderBy("c").collect()] == want and best == max(want, key=lambda r: r[1])[0]


def test_classifier(spark):
    """Labels, confidences and nets are those of the fitted probabilities."""
    import numpy as np

    rows, schema = class_rows(random.Random(2), 240)
    df = spark.createDataFrame(rows, schema)
    w = fit_alone(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), 1.0)
    z = np.hstack([np.array([r[1] for r in rows]), np.ones((240, 1))]) @ w.T
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    out = tiers.escalate(tiers.classify(df, tiers.train_classifier(df, 1.0)), 0.6, True).orderBy("id").collect()
    for r, q in zip(out, p, strict=True):
        assert r.confidence == pytest.approx(q.max(), abs=1e-3) and r.net_score == pytest.approx(q[2] - q[0], abs=1e-3)
        assert r.label == d.LABELS[int(q.argmax())] or np.sort(q)[-1] - np.sort(q)[-2] < 1e-3
        assert r.method == ("llm_pending" if r.confidence < 0.6 else "embedding")


def test_tiers_as_one_flow(spark, tmp_path):
    """Each tier sees only what was left; the counts come from the pass that writes."""
    rows = [(i, [["x"]] * (i % 2), 0.5) for i in range(40)]
    df = spark.createDataFrame([(i, "a" if h else None, n) for i, h, n in rows], "id int, hit string, net_score double")
    lists = {c: F.when(F.col("hit").isNotNull(), F.array("hit")).otherwise(F.array().cast("array<string>")) if c == "growth_lm" else F.array().cast("array<string>") for c in scoring.HIT_LISTS}
    df = df.withColumns({**lists, **{c: F.lit(0.0) for c in scoring.SCORES}})
    sizes, n = [], [0]

    def cut(x):
        n[0] += 1
        x.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.parquet(str(tmp_path / str(n[0])))

    def tier(method, test):
        def run(x):
            sizes.append(x.count())
            return x.withColumns({"method": F.when(F.expr(test), method).otherwise("pending"), "label": F.lit("positive")})
        return run

    out, seen = tiers.observe_tiers(tiers.tiered(df, tier("embedding", "id < 20"), tier("llm", "id < 30"), cut=cut))
    out.write.parquet(str(tmp_path / "out"))
    assert sizes == [20, 10]
    got = sorted(map(tuple, tiers.observed_stats(spark, seen).collect()))
    assert got == sorted(map(tuple, tiers.tier_stats(spark.read.parquet(str(tmp_path / "out"))).collect())) and [r[:2] for r in got] == [("embedding", 10), ("lexicon", 20), ("llm", 5), ("pending", 5)]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ticker": "A",\n "form_type": "10-K", "raw_text": "x"}')
    (tmp_path / "in" / "b.json").write_text("{broken")
    (tmp_path / "in" / "_index.json").write_text('{"ticker": "no"}')
    good, bad = records.read_records(spark, [str(tmp_path / "in")])
    assert [r.ticker for r in good.collect()] == ["A"] and bad.count() == 1
    assert records.load_baseline(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        records.lexicon_words(spark.createDataFrame([("A",)], "Word string"))
    feed = spark.createDataFrame([("A", (["10-K", "10-Q"], ["1", "2"]))], "company string, recent struct<form: array<string>, acc: array<string>>")
    assert [tuple(r) for r in records.unnest_feed(feed, "recent", ["form", "acc"]).collect()] == [("A", 0, "10-K", "1"), ("A", 1, "10-Q", "2")]


def test_stream_is_incremental(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    once = lambda: incremental.process_new_files(spark, source, "id long", lambda df: df.withColumn("twice", F.col("id") * 2), sink, mark)
    spark.range(3).write.parquet(source)
    once()
    spark.range(3, 5).write.mode("append").parquet(source)
    once()
    once()
    assert sorted(r.twice for r in spark.read.parquet(sink).collect()) == [0, 2, 4, 6, 8]


def test_stream_by_key(spark, tmp_path):
    """Records delivered again are dropped; a batch whose commit was lost runs again and leaves no row twice."""
    source, sink, mark = (str(tmp_path / x) for x in ("source", "sink", "mark"))
    schema = "ticker string, form_type string, filing_date string, v int"
    row = lambda k, v: (f"T{k}", "10-K", "2024-01-01", v)
    def deliver(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
        incremental.process_new_records(spark, source, schema, lambda df: df.withColumn("twice", F.col("v") * 2), sink, mark)

    seen = lambda: sorted((r.ticker, r.twice) for r in spark.read.parquet(sink).collect())
    deliver(row(1, 1), row(2, 2), row(2, 2))
    deliver(row(2, 2), row(3, 3))
    deliver(row(1, 1))
    assert seen() == [("T1", 2), ("T2", 4), ("T3", 6)]
    deliver(row(4, 4), row(5, 5))
    last = max((tmp_path / "mark" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    incremental.process_new_records(spark, source, schema, lambda df: df.withColumn("twice", F.col("v") * 2), sink, mark)
    deliver(row(5, 5), row(6, 6))
    assert seen() == [("T1", 2), ("T2", 4), ("T3", 6), ("T4", 8), ("T5", 10), ("T6", 12)]


def test_baseline_states_merge(spark):
    """States of parts merge into exactly the state of all, in any order."""
    rng = random.Random(12)
    rows = [(f"T{rng.randint(0, 30)}", rng.choice(["A", "B", "C"]), round(rng.gauss(0, 3), 3), round(rng.gauss(1, 2), 3)) for _ in range(300)]
    df = spark.createDataFrame(rows, "ticker string, sector string, growth double, risk double").withColumn("k", F.monotonically_increasing_id() % 3).cache()
    whole = sorted(map(tuple, baseline.stats_of(baseline.baseline_state(df)).collect()), key=repr)
    parts = [baseline.baseline_state(df.where(f"k = {k}")) for k in (2, 0, 1)]
    assert sorted(map(tuple, baseline.stats_of(baseline.merge_states(parts[0], baseline.merge_states(*parts[1:]))).collect()), key=repr) == whole
    import statistics

    for r in (x for x in whole if x[1] != "_corpus_all"):
        mine = [g for _, s, g, _ in rows if s == r[1]]
        assert r[2] == len(mine) and r[5] == pytest.approx(statistics.mean(mine), abs=6e-5) and r[6] == pytest.approx(statistics.stdev(mine), abs=6e-5)


def test_pooling(spark):
    rows = [(1, "a", [1.0, 2.0]), (1, "b", [3.0, 4.0]), (2, "c", [5.0, 6.0]), (2, "c", None)]
    tv = spark.createDataFrame(rows, "id int, word string, vector array<double>")
    idf = spark.createDataFrame([("a", 3.0)], "word string, idf double")
    got = {r.id: r.vector for r in tiers.idf_weighted_pool(tv, idf).collect()}
    assert got[1] == pytest.approx([1.5, 2.5]) and got[2] == pytest.approx([5.0, 6.0])
    assert {r.id: r.vector for r in tiers.idf_weighted_pool(tv, None).collect()}[1] == pytest.approx([2.0, 3.0])


def test_idf(spark):
    texts = ["up up Down", "down été", "", None, "up"]
    got = {r.word: (r.tf, r.df) for r in tiers.fit_idf(spark.createDataFrame([(x,) for x in texts], "text string")).collect()}
    assert got == {"up": (3, 2), "down": (2, 2), "été": (1, 1)}


def test_split_by_ranges(spark):
    """The same rows as by a sort of each whole label."""
    import hashlib

    rows = [(i, d.LABELS[min(i % 7, 2)]) for i in range(900)] + [(None, "neutral")]
    df = spark.createDataFrame(rows, "id long, true_label string")
    got = {r.id: r.split for r in evaluation.stratified_split(df).collect()}
    for label in d.LABELS:
        mine = sorted((i for i, x in rows if x == label), key=lambda i: hashlib.md5(f"{'' if i is None else i}|42".encode()).hexdigest())
        n = len(mine)
        for k, i in enumerate(mine, 1):
            assert got[i] == ("train" if k <= int(n * 0.7 + 0.5) else "val" if k <= int(n * (0.7 + 0.15) + 0.5) else "test")


def test_version_fallback(spark):
    """Version 3 without scope words is version 2, once."""
    df = feats(spark, [("mdna", "we are not seeing any strong demand at all today")])
    s = scoring.Scorer(growth=["strong"], scope_negations=[])
    v2 = scoring.score_sentences(df, s, "v2").collect()
    assert scoring.score_sentences(df, s, "v3").collect() == v2 and v2[0].engine_version == "v2"
    assert [r.engine_version for r in scoring.score_versions(df, s, ["v1", "v2", "v3"]).collect()] == ["v1", "v2"]


def test_blocked_words():
    """The second version's lexicon keeps words of benefit that the first leaves out."""
    words = ["able", "benefit", "strong", "success", "enjoyed"]
    assert scoring.without_blocked(words) == ["benefit", "strong", "enjoyed"] and scoring.without_blocked(words, d.GROWTH_BLOCKED) == ["strong"]
