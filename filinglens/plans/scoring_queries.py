"""Queries of sentence features, scores, document tables and baselines (rows D, E, F, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions import text as t
from ..operators import baseline, documents, scoring, sentences
from ..sources import records as src
from . import corpus as c
from .corpus import FEAT, HIT, RAW, SCORER, SENTS, Query, featured, hits, j, joined, mean_s, r4, r4s, scored, scored_documents, scores_sql, split, table

#: A phrase list comes from a dictionary; more entries than this are no list any more.
MOST_PHRASES = 1_000_000

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


long = lambda x, name: x.cast("long").alias(name)


@query(f"WITH {SENTS} SELECT doc_id, sent_id, section, text FROM sents")
def d1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("doc_id", "sent_id", "section", "text")


@query(f"WITH {FEAT} SELECT doc_id, sent_id, CAST(len(tk) AS BIGINT) AS n_tokens, array_to_string(tk, ' ') AS lemmas, CAST(len([x for x in tk if x IN ({c.quoted(c.STOP)})]) AS BIGINT) AS n_stop FROM feat")
def d2_tokens(spark: SparkSession, sf: str) -> DataFrame:
    f = split(spark, sf).select("doc_id", "sent_id", F.explode(F.array(t.tokens(F.col("text"), c.STOP, c.NEGATION, c.PATTERN))).alias("tokens"))
    return f.select("doc_id", "sent_id", long(F.size("tokens"), "n_tokens"), F.array_join("tokens.lemma", " ").alias("lemmas"), long(F.size(F.filter("tokens", lambda x: x["is_stop"])), "n_stop"))


#: A dictionary out of the texts: forms in s whose rest is a form as well.
LEMMAS = f"""forms AS (SELECT DISTINCT unnest(list_distinct([lower(x) for x in regexp_extract_all(text, '{c.PATTERN}')])) AS form FROM documents),
lemmas AS (SELECT a.form, b.form AS lemma FROM forms a JOIN forms b ON a.form = b.form || 's' WHERE length(a.form) > 3),
each AS (SELECT doc_id, sent_id, unnest(tk) AS form, generate_subscripts(tk, 1) AS pos FROM feat),
lem2 AS (SELECT doc_id, sent_id, string_agg(coalesce(lemma, form), ' ' ORDER BY pos) AS lemmas, count(lemma) AS n_changed FROM each LEFT JOIN lemmas USING (form) GROUP BY doc_id, sent_id)"""


def lemma_table(spark: SparkSession, sf: str) -> DataFrame:
    found = t.forms(F.col("text"), c.PATTERN)
    forms = table(spark, sf, "documents").select(F.explode(F.array_distinct(found)).alias("form")).distinct()
    stems = forms.select(F.concat("form", F.lit("s")).alias("form"), F.col("form").alias("lemma"))
    return c.once(forms.where(F.length("form") > 3).join(stems, "form"))


def _lemma_rows(df: DataFrame) -> DataFrame:
    changed = F.filter(F.arrays_zip("words", "lemma"), lambda x: x["words"] != x["lemma"])
    return df.select("doc_id", "sent_id", F.array_join("lemma", " ").alias("lemmas"), long(F.size(changed), "n_changed"))


@query(f"WITH {FEAT}, {LEMMAS} SELECT * FROM lem2")
def d2_lemmas(spark: SparkSession, sf: str) -> DataFrame:
    """Words by a dictionary that is sent to every worker."""
    lemma = models.lemma_column(lemma_table(spark, sf))
    if lemma is None:
        return d2_lemmas_by_join(spark, sf)
    words = split(spark, sf).select("doc_id", "sent_id", t.forms(F.col("text"), c.PATTERN).alias("words")).where(F.size("words") > 0)
    return _lemma_rows(words.withColumn("lemma", lemma(F.col("words"))))


@query(f"WITH {FEAT}, {LEMMAS} SELECT * FROM lem2")
def d2_lemmas_by_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same by a join, as for a dictionary of any size: each document's different words meet it, not each sentence's."""
    docs = c.sections(spark, sf)
    known = models.known_forms(docs.select("doc_id", t.forms(F.col("body"), c.PATTERN).alias("words")), lemma_table(spark, sf), ["doc_id"])
    sents = sentences.split_sentences(docs.select("doc_id", "body").join(known, "doc_id", "left"), one_section=True)
    words = sents.select("doc_id", "sent_id", "known", c.held(t.forms(F.col("text"), c.PATTERN)).alias("words")).where(F.size("words") > 0)
    return _lemma_rows(words.select("doc_id", "sent_id", "words", c.held(models.by_known(F.col("words"), F.col("known"))).alias("lemma")))


@query(f"WITH {FEAT} SELECT doc_id, sent_id, has_negation FROM feat")
def d3_has_negation(spark: SparkSession, sf: str) -> DataFrame:
    return featured(spark, sf).select("doc_id", "sent_id", "has_negation")


@query(f"WITH {FEAT} SELECT doc_id, sent_id, has_hedge FROM feat")
def d4_has_hedge(spark: SparkSession, sf: str) -> DataFrame:
    return featured(spark, sf).select("doc_id", "sent_id", "has_hedge")


def _mask_sql(x: str) -> str:
    for p, m in t.MASKS:
        x = f"regexp_replace({x}, '{p}', '{m}', 'g')"
    return x


@query(f"WITH {SENTS} SELECT doc_id, sent_id, {_mask_sql('lower(text)')} AS text_masked FROM sents")
def d5_mask_entities(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("doc_id", "sent_id", t.mask_entities(F.col("text")).alias("text_masked"))


#: A stand-in for a parser's noun phrases: runs of capitalised words.
PHRASE = "[A-Z][a-z]*( [A-Z][a-z]*)*"


@query(f"WITH {SENTS} SELECT doc_id, sent_id, CAST(len(p) AS BIGINT) AS n_noun_phrases, array_to_string(p, '|') AS noun_phrases FROM (SELECT doc_id, sent_id, [x for x in regexp_extract_all(text, '{PHRASE}') if length(x) BETWEEN 2 AND 49] AS p FROM sents)")
def d6_noun_phrases(spark: SparkSession, sf: str) -> DataFrame:
    found = sentences.add_features(split(spark, sf), c.FEATURES, nouns=lambda x: F.regexp_extract_all(x, F.lit(PHRASE), F.lit(0)))
    return found.select("doc_id", "sent_id", long(F.size("noun_phrases"), "n_noun_phrases"), F.array_join("noun_phrases", "|").alias("noun_phrases"))


def _phrase_model():
    """A model as workers load it: batches of texts to lists of phrases."""
    import re

    import pyarrow as pa

    found = re.compile(PHRASE)
    return lambda texts: pa.array([None if x is None else [m[0] for m in found.finditer(x)] for x in texts.to_pylist()], pa.list_(pa.string()))


@query(SQL["d6_noun_phrases"])
def d6_noun_phrases_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """The same through a model in Python, loaded once a worker."""
    found = sentences.add_features(split(spark, sf), c.FEATURES, nouns=models.model_column(_phrase_model, "array<string>"))
    return found.select("doc_id", "sent_id", long(F.size("noun_phrases"), "n_noun_phrases"), F.array_join("noun_phrases", "|").alias("noun_phrases"))


@query(f"WITH {FEAT} SELECT doc_id, count(*) AS n_sentences, CAST(sum(len(tk)) AS BIGINT) AS n_tokens, count(*) FILTER (has_negation) AS n_negated, count(*) FILTER (has_hedge) AS n_hedged, any_value(section) || '=' || count(*) AS by_section FROM feat GROUP BY doc_id")
def d7_preprocess_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = sentences.stats_of(sentences.sentence_array(F.array(F.struct("section", "body"))), c.FEATURES)
    s = c.sections(spark, sf).select("doc_id", found.alias("s")).select("doc_id", "s.*").where("n_sentences > 0")
    by = F.array_join(F.transform(F.map_entries("sentences_by_section"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.select("doc_id", "n_sentences", "n_tokens", "n_negated", "n_hedged", by.alias("by_section"))


@query(f"WITH {FEAT} SELECT doc_id, sent_id FROM feat WHERE len(tk) >= 5")
def d8_min_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.min_tokens(featured(spark, sf), 5).select("doc_id", "sent_id")


@query(f"WITH {HIT} SELECT doc_id, sent_id, {j('growth_lm')}, {j('risk_lm')}, {j('uncertainty_lm')} FROM hit")
def e1_lexicon_hits(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("doc_id", "sent_id", joined("growth_lm"), joined("risk_lm"), joined("uncertainty_lm"))


@query(f"WITH {HIT} SELECT doc_id, sent_id, {j('growth_lm')}, {j('risk_lm')}, {j('uncertainty_lm')} FROM hit WHERE len(growth_lm) + len(risk_lm) + len(uncertainty_lm) > 0")
def e1_lexicon_hits_by_join(spark: SparkSession, sf: str) -> DataFrame:
    words = [(w, k) for k, ws in (("growth", SCORER.growth), ("risk", SCORER.risk), ("uncertainty", SCORER.uncertainty)) for w in ws]
    found = scoring.hits_by_join(featured(spark, sf), spark.createDataFrame(words, "word string, category string"), ["doc_id", "sent_id"])
    return found.select("doc_id", "sent_id", joined("growth_lm"), joined("risk_lm"), joined("uncertainty_lm"))


@query(f"WITH {HIT} SELECT doc_id, sent_id, {j('growth_phrases')}, {j('risk_phrases')}, {j('cost_phrases')} FROM hit")
def e2_phrase_hits(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("doc_id", "sent_id", joined("growth_phrases"), joined("risk_phrases"), joined("cost_phrases"))


#: Many phrases: every two words that follow each other in a benchmark item.
MANY = """many AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS p FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT string_split(lower(text), ' ') AS w FROM benchmark)) WHERE w[i] <> '' AND w[i + 1] <> '')"""


@query(f"WITH {SENTS}, {MANY} SELECT doc_id, sent_id, count(*) AS n, string_agg(p, '|' ORDER BY p) AS phrases FROM sents JOIN many ON contains(lower(text), p) GROUP BY doc_id, sent_id")
def e2_many_phrases(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split(F.lower("text"), " ", -1)
    pairs = F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.when((F.get(w, i) != "") & (x != ""), F.concat_ws(" ", F.get(w, i), x)))
    rows = table(spark, sf, "benchmark").select(F.explode(F.array_compact(pairs)).alias("p")).distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"over {MOST_PHRASES} phrases are no list any more")
    found = split(spark, sf).withColumn("found", models.phrase_column([r.p for r in rows])(F.lower("text"))).where(F.size("found") > 0)
    return found.select("doc_id", "sent_id", long(F.size("found"), "n"), F.array_join("found", "|").alias("phrases"))


def _three(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "sent_id", r4("growth"), r4("risk"), r4("cost_pressure"))


def _three_sql(g: str, r: str, k: str, source: str = "raw") -> str:
    return f"SELECT doc_id, sent_id, {r4s(g, 'growth')}, {r4s(r, 'risk')}, {r4s(k, 'cost_pressure')} FROM {source}"


@query(f"WITH {RAW} {_three_sql('g0', 'r0', 'c0')}")
def e3_raw_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.raw_scores(hits(spark, sf)))


@query(f"WITH {RAW} {_three_sql(*c.NEGATED['v1'])}")
def e4_negate_flip(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.negate_flip(scoring.raw_scores(hits(spark, sf))))


@query(f"WITH {RAW} {_three_sql(*c.NEGATED['v2'])}")
def e5_negate_zero(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.negate_zero(scoring.raw_scores(hits(spark, sf))))


@query(f"WITH {RAW} {_three_sql(*c.NEGATED['v3'])}")
def e6_negate_scope(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.negate_scope(scoring.raw_scores(hits(spark, sf)), SCORER))


_H = "(CASE WHEN has_hedge THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END)"


@query(f"WITH {RAW} {_three_sql(f'g0 * {_H}', f'r0 * {_H}', f'c0 * {_H}')}")
def e7_hedge_damp(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.hedge_damp(scoring.raw_scores(hits(spark, sf))))


@query(f"WITH {RAW} {_three_sql(f'g0 * ({c.WEIGHT})', f'r0 * ({c.WEIGHT})', f'c0 * ({c.WEIGHT})')}")
def e8_section_weight(spark: SparkSession, sf: str) -> DataFrame:
    return _three(scoring.weigh_sections(scoring.raw_scores(hits(spark, sf)), SCORER))


@query(f"WITH {scores_sql()} SELECT doc_id, sent_id, {r4s('net_score')} FROM sc")
def e9_net_score(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("doc_id", "sent_id", r4("net_score"))


@query(f"WITH {scores_sql()} SELECT doc_id, sent_id, CASE WHEN net_score > 0.1 THEN 'positive' WHEN net_score < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM sc")
def e10_net_to_label(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("doc_id", "sent_id", t.net_label(F.col("net_score")).alias("label"))


ANY_HIT = "len(growth_lm) + len(growth_phrases) + len(risk_lm) + len(risk_phrases) + len(uncertainty_lm) + len(cost_phrases) > 0"


@query(f"WITH {HIT} SELECT doc_id, sent_id, {ANY_HIT} AS has_hit FROM hit")
def e11_has_hit(spark: SparkSession, sf: str) -> DataFrame:
    return hits(spark, sf).select("doc_id", "sent_id", scoring.has_hit().alias("has_hit"))


@query(f"WITH {FEAT} SELECT doc_id, sent_id, array_to_string(list_sort(list_intersect(lem, ['from', 'are'])), ',') AS growth_lm FROM feat")
def e12_lexicon_v2(spark: SparkSession, sf: str) -> DataFrame:
    words = scoring.without_blocked(SCORER.growth, ["with"])
    return featured(spark, sf).select("doc_id", "sent_id", F.array_join(t.lexicon_hits(F.col("terms"), words), ",").alias("growth_lm"))


_S = f"(CASE WHEN has_negation THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) * {_H}"


@query(f"WITH {HIT} SELECT doc_id, {r4s(f'sum({_S} * len(growth_lm))', 'growth')}, {r4s(f'sum({_S} * len(risk_lm))', 'risk')} FROM hit WHERE len(tk) >= 6 GROUP BY doc_id")
def e13_simple_score(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.simple_score(featured(spark, sf), SCORER).select("doc_id", r4("growth"), r4("risk"))


def _versions_sql() -> str:
    each = [f"(WITH {scores_sql(v)} SELECT '{v}' AS engine_version, doc_id, sent_id, {r4s('growth')}, {r4s('risk')}, {r4s('cost_pressure')}, {r4s('net_score')} FROM sc)" for v in c.NEGATED]
    return " UNION ALL ".join(f"SELECT * FROM {e}" for e in each)


@query(_versions_sql())
def e14_engine_version(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score_versions(featured(spark, sf), SCORER, list(c.NEGATED)).select("engine_version", "doc_id", "sent_id", r4("growth"), r4("risk"), r4("cost_pressure"), r4("net_score"))


DOCS = scores_sql() + f""",
ds AS (SELECT d.doc_id, d.source, coalesce(g, 0) + 0.0 AS growth, coalesce(r, 0) + 0.0 AS risk, coalesce(k, 0) + 0.0 AS cost_pressure, coalesce(net, 0) + 0.0 AS net_operating_signal
 FROM documents d LEFT JOIN (SELECT doc_id, {mean_s('growth', 3)} AS g, {mean_s('risk', 3)} AS r, {mean_s('cost_pressure', 3)} AS k, {mean_s('growth - risk', 3)} AS net FROM sc GROUP BY doc_id) USING (doc_id))"""


def doc_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = scored_documents(spark, sf).select("doc_id", "source", c.held(documents.scores_of(F.col("scored"))).alias("s")).select("doc_id", "source", "s.*")
    return out.withColumns({x: F.col(x) + 0.0 for x in ("growth", "risk", "cost_pressure", "net_operating_signal")})


@query(f"WITH {DOCS} SELECT * FROM ds")
def f1_document_scores(spark: SparkSession, sf: str) -> DataFrame:
    return doc_scores(spark, sf)


def covered(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, scored, scored_with_hits) of every document."""
    return scored_documents(spark, sf).select("doc_id", "source", c.held(documents.coverage_of(F.col("scored"))).alias("c")).select("doc_id", "source", "c.*")


def tops(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).select("doc_id", c.held(documents.top_of(F.col("scored"))).alias("x")).select("doc_id", F.inline("x"))


def tallies(spark: SparkSession, sf: str) -> DataFrame:
    return scored_documents(spark, sf).select("doc_id", c.held(documents.tally_of(F.col("scored"))).alias("x")).select("doc_id", F.inline("x"))


@query(f"WITH {scores_sql()} SELECT doc_id, count(*) AS scored, count(*) FILTER ({ANY_HIT}) AS scored_with_hits FROM sc GROUP BY doc_id")
def f2_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return documents.coverage(scoring.hit_rows(split(spark, sf).select("doc_id", "text"), SCORER, c.FEATURES), hit=F.col("any_hit"))


TURN_SECTION = "CASE role WHEN 'user' THEN 'qa_Q' WHEN 'assistant' THEN 'qa_A' ELSE 'prepared_remarks' END"


@query(f"""WITH p AS (SELECT conv_id, {TURN_SECTION} AS section, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM conversations)
SELECT conv_id AS doc_id, section, count(*) AS n, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, section) AS INTEGER) AS ord FROM p WHERE length(trim(s)) >= 3 GROUP BY conv_id, section""")
def f3_sentences_by_section(spark: SparkSession, sf: str) -> DataFrame:
    sec = F.when(F.col("role") == "user", "qa_Q").when(F.col("role") == "assistant", "qa_A").otherwise("prepared_remarks")
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_ord"), sec.alias("section"), F.col("text").alias("body"))
    return documents.sentences_by_section(sentences.split_sentences(turns))


TOP = scores_sql() + """,
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(abs(net_score) + abs(cost_pressure), 6) DESC, sent_id) AS INTEGER) AS rank FROM sc) WHERE rank <= 20)"""


@query(f"WITH {TOP} SELECT doc_id, rank, sent_id, round(net_score, 2) + 0.0 AS net_score FROM top")
def f4_top_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return tops(spark, sf).select("doc_id", "rank", "sent_id", (F.round("net_score", 2) + 0.0).alias("net_score"))


TALLY = scores_sql() + """,
th AS (SELECT doc_id, sent_id, 'growth' AS dimension, 'LM' AS source, 1 AS late, unnest(growth_lm) AS term FROM sc UNION ALL SELECT doc_id, sent_id, 'growth', 'phrase', 0, unnest(growth_phrases) FROM sc
 UNION ALL SELECT doc_id, sent_id, 'risk', 'LM', 1, unnest(risk_lm) FROM sc UNION ALL SELECT doc_id, sent_id, 'risk', 'phrase', 0, unnest(risk_phrases) FROM sc UNION ALL SELECT doc_id, sent_id, 'cost_pressure', 'phrase', 0, unnest(cost_phrases) FROM sc),
tally AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, dimension ORDER BY count DESC, term) AS INTEGER) AS rank FROM
 (SELECT doc_id, dimension, term, arg_max(source, sent_id * 2 + late) AS source, count(*) AS count FROM th GROUP BY doc_id, dimension, term)) WHERE rank <= 25)"""


@query(f"WITH {TALLY} SELECT * FROM tally")
def f5_tally_terms(spark: SparkSession, sf: str) -> DataFrame:
    return tallies(spark, sf)


@query(f"WITH {TALLY} SELECT doc_id, dimension, term, source, count FROM tally WHERE rank <= 4")
def f6_phrase_table(spark: SparkSession, sf: str) -> DataFrame:
    return documents.phrase_table(tallies(spark, sf)).drop("rank")


BINS_SQL = """bins(ord, bin, lo, hi) AS (VALUES (0, '<= -4', -10.0, -4.0), (1, '-4 to -2', -4.0, -2.0), (2, '-2 to 0', -2.0, 0.0), (3, '0 to 2', 0.0, 2.0), (4, '2 to 4', 2.0, 4.0), (5, '>= 4', 4.0, 10.0))"""


@query(f"WITH {scores_sql()}, {BINS_SQL} SELECT CAST(ord AS INTEGER) AS ord, bin, count(doc_id) AS n FROM bins LEFT JOIN sc ON (net_score > lo OR (ord = 0 AND net_score = lo)) AND net_score <= hi GROUP BY ord, bin")
def f7_net_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return documents.net_histogram(scored(spark, sf))


@query(f"WITH {TOP} SELECT doc_id, rank, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '…' ELSE text END AS text, array_to_string(growth_lm || growth_phrases, ', ') AS growth_terms, array_to_string(risk_lm || risk_phrases, ', ') AS risk_terms, array_to_string(cost_phrases, ', ') AS cost_terms FROM top WHERE rank <= 10")
def f8_evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    return documents.evidence_table(tops(spark, sf))


@query(f"WITH {TALLY}, {DOCS[len(scores_sql()) + 1:]}, dt AS (SELECT doc_id, arg_min(term, (CASE dimension WHEN 'growth' THEN 0 WHEN 'risk' THEN 1 ELSE 2 END) * 100 + rank) AS dominant_term FROM tally GROUP BY doc_id) SELECT ds.doc_id, CASE WHEN abs(growth) >= abs(risk) AND abs(growth) >= abs(cost_pressure) THEN 'growth' WHEN abs(risk) >= abs(cost_pressure) THEN 'risk' ELSE 'cost_pressure' END AS strongest, dominant_term FROM ds LEFT JOIN dt USING (doc_id)")
def f9_strongest_dimension(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("scored")
    both = scored_documents(spark, sf).select("doc_id", documents.scores_of(x).alias("s"), documents.dominant_of(documents.tally_of(x)).alias("dominant_term"))
    return documents.strongest_dimension(both.select("doc_id", "s.*", "dominant_term")).select("doc_id", "strongest", "dominant_term")


SECTOR_CASE = "CASE WHEN n <= 4 THEN 'S1' WHEN n <= 9 THEN 'S2' WHEN n <= 14 THEN 'S3' WHEN n <= 16 THEN 'S4' ELSE 'Unknown' END"
SECTORED = DOCS + f""",
dz AS (SELECT *, {SECTOR_CASE} AS sector FROM (SELECT *, CAST(substr(source, 4) AS INTEGER) AS n FROM ds))"""
BASE = SECTORED + f""",
latest AS (SELECT * FROM dz QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1),
bl AS (SELECT 'v1' AS engine_version, coalesce(sector, '_corpus_all') AS reference, count(*) AS n, list_sort(list(DISTINCT source)) AS tickers, count(*) >= 4 AS reliable, {mean_s("growth")} AS growth_mean,
 CASE WHEN count(*) = 1 OR stddev_samp(growth) <= 1e-9 THEN 1.0 ELSE round(stddev_samp(growth), 4) END AS growth_stdev, {mean_s("risk")} AS risk_mean,
 CASE WHEN count(*) = 1 OR stddev_samp(risk) <= 1e-9 THEN 1.0 ELSE round(stddev_samp(risk), 4) END AS risk_stdev
 FROM {{}} GROUP BY GROUPING SETS ((sector), ()))"""
LATEST, WHOLE = BASE.replace("{}", "latest"), BASE.replace("{}", "dz")


def sector_map(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of the corpus as tickers: src0-4 S1, 5-9 S2, 10-14 S3, 15-16 S4, the others unmapped."""
    n = F.col("n")
    s = F.when(n <= 4, "S1").when(n <= 9, "S2").when(n <= 14, "S3").when(n <= 16, "S4")
    sources = table(spark, sf, "documents").select(F.col("source").alias("ticker")).distinct().withColumn("n", F.substring("ticker", 4, 9).cast("int"))
    return sources.withColumn("sector", s).where("sector IS NOT NULL").select("ticker", "sector")


def sectored(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.sector_for(doc_scores(spark, sf), sector_map(spark, sf), "source")


@query(f"SELECT doc_id, {SECTOR_CASE} AS sector FROM (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)")
def g1_sector_for(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.sector_for(table(spark, sf, "documents").select("doc_id", "source"), sector_map(spark, sf), "source").select("doc_id", "sector")


@query(f"SELECT sector, count(*) AS n, string_agg(source, ',' ORDER BY source) AS tickers FROM (SELECT *, {SECTOR_CASE} AS sector FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)) WHERE sector <> 'Unknown' GROUP BY sector")
def g2_sector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.sector_coverage(sector_map(spark, sf)).select("sector", "n", joined("tickers"))


@query("SELECT doc_id, source FROM documents WHERE CAST(substr(source, 4) AS INTEGER) BETWEEN 5 AND 14")
def g3_baseline_universe(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.baseline_universe(table(spark, sf, "documents").select("doc_id", "source"), sector_map(spark, sf), ["S2", "S3"], "source")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id % 50 DESC, doc_id) = 1")
def g4_latest_per_ticker(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "doc_id", (F.col("doc_id") % 50).alias("date"))
    return baseline.latest_per_ticker(d, "source", "date", "doc_id").select("source", "doc_id")


def latest_baseline(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The baseline of the latest document of every source, out of ``rows`` (sectored document scores) where they are known."""
    d = (sectored(spark, sf) if rows is None else rows).withColumn("pos", -F.col("doc_id"))
    last = baseline.latest_per_ticker(d.withColumn("date", F.lit("")), "source", "date", "pos")
    return baseline.baseline_stats(last, ticker="source")


BL = "engine_version, reference, n, array_to_string(tickers, ',') AS tickers, reliable, growth_mean + 0.0 AS growth_mean, growth_stdev, risk_mean + 0.0 AS risk_mean, risk_stdev"


def _flat(b: DataFrame) -> DataFrame:
    return b.select("engine_version", "reference", "n", joined("tickers"), "reliable", (F.col("growth_mean") + 0.0).alias("growth_mean"), "growth_stdev", (F.col("risk_mean") + 0.0).alias("risk_mean"), "risk_stdev")


@query(f"WITH {LATEST} SELECT {BL} FROM bl WHERE reference <> '_corpus_all'")
def g5_sector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(latest_baseline(spark, sf)).where("reference <> '_corpus_all'")


@query(f"WITH {WHOLE} SELECT {BL} FROM bl")
def g5_merged_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """A stored state of some reports and that of those that came later, merged."""
    rows, path = c.once(sectored(spark, sf)), c.scratch(spark)
    baseline.baseline_state(rows.where("doc_id % 3 <> 0"), ticker="source").write.parquet(path)
    later = baseline.baseline_state(rows.where("doc_id % 3 = 0"), ticker="source")
    return _flat(baseline.stats_of(baseline.merge_states(spark.read.parquet(path), later)))


@query(f"WITH {WHOLE} SELECT {BL} FROM bl WHERE reference = '_corpus_all'")
def g6_corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(baseline.baseline_stats(sectored(spark, sf), ticker="source")).where("reference = '_corpus_all'")


Z = LATEST + """,
zs AS (SELECT dz.*, o.reference IS NOT NULL AS is_sector_specific, coalesce(o.reference, a.reference) AS reference, coalesce(o.n, a.n) AS reference_n,
 (growth - coalesce(o.growth_mean, a.growth_mean)) / coalesce(o.growth_stdev, a.growth_stdev) AS zg, (risk - coalesce(o.risk_mean, a.risk_mean)) / coalesce(o.risk_stdev, a.risk_stdev) AS zr
 FROM dz LEFT JOIN bl o ON o.reference = dz.sector AND o.reliable JOIN bl a ON a.reference = '_corpus_all')"""


def zscored(spark: SparkSession, sf: str) -> DataFrame:
    rows = c.once(sectored(spark, sf))
    return baseline.apply_zscores(rows.withColumn("engine_version", F.lit("v1")), latest_baseline(spark, sf, rows))


@query(f"WITH {Z} SELECT doc_id, sector, reference, reference_n, is_sector_specific, round(zg, 3) + 0.0 AS z_growth, round(zr, 3) + 0.0 AS z_risk, round(zg - zr, 3) + 0.0 AS z_net FROM zs")
def g7_apply_zscores(spark: SparkSession, sf: str) -> DataFrame:
    z = lambda n: (F.col(n) + 0.0).alias(n)
    return zscored(spark, sf).select("doc_id", "sector", "reference", "reference_n", "is_sector_specific", z("z_growth"), z("z_risk"), z("z_net"))


@query(f"WITH {Z} SELECT doc_id, CASE WHEN reference = '_corpus_all' THEN 'All sectors combined (n=' || reference_n || '). Ticker not mapped to a specific sector, so compared against the full reference corpus. Sector-specific comparison would be more precise.' ELSE reference || ' sector peers (n=' || reference_n || ')' END AS reference_label FROM zs")
def g8_reference_label(spark: SparkSession, sf: str) -> DataFrame:
    return zscored(spark, sf).select("doc_id", "reference_label")


@query(f"WITH {LATEST} SELECT CASE WHEN reference = '_corpus_all' THEN 'ALL (corpus)' ELSE reference END AS name, CAST(row_number() OVER (ORDER BY reference = '_corpus_all', reference) AS INTEGER) AS ord, n, array_to_string(tickers[1:8], ', ') || CASE WHEN len(tickers) > 8 THEN ' +' || (len(tickers) - 8) ELSE '' END AS tickers_shown FROM bl")
def g9_baseline_rows(spark: SparkSession, sf: str) -> DataFrame:
    return baseline.baseline_rows(latest_baseline(spark, sf)).select("name", "ord", "n", "tickers_shown")


@query(f"WITH {Z} SELECT doc_id, source, growth, risk, cost_pressure, net_operating_signal, CASE WHEN is_sector_specific THEN round(zg, 3) + 0.0 END AS z_growth, CASE WHEN is_sector_specific THEN round(zg - zr, 3) + 0.0 END AS z_net FROM zs")
def f10_comparison_rows(spark: SparkSession, sf: str) -> DataFrame:
    scores = c.once(doc_scores(spark, sf))
    rows = baseline.sector_for(scores, sector_map(spark, sf), "source")
    z = baseline.apply_zscores(rows.withColumn("engine_version", F.lit("v1")), latest_baseline(spark, sf, rows)).where("is_sector_specific")
    z = z.select("doc_id", *[(F.col(n) + 0.0).alias(n) for n in ("z_growth", "z_risk", "z_net")])
    return documents.comparison_rows(scores, z).drop("z_risk")


@query(f"WITH {DOCS} SELECT doc_id, unnest(['growth', 'risk', 'cost_pressure', 'net_operating_signal']) AS metric, unnest([growth, risk, cost_pressure, net_operating_signal]) AS value FROM ds")
def f11_metric_melt(spark: SparkSession, sf: str) -> DataFrame:
    return documents.metric_melt(doc_scores(spark, sf), "doc_id")


@query(f"WITH {DOCS} SELECT doc_id, net_operating_signal, round(net_operating_signal - lag(net_operating_signal) OVER (PARTITION BY source ORDER BY doc_id), 3) + 0.0 AS net_change FROM ds")
def f12_net_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = documents.net_trend(doc_scores(spark, sf), "source", ["doc_id"], 1)
    return out.select("doc_id", "net_operating_signal", (F.round("net_change", 3) + 0.0).alias("net_change"))


@query(f"WITH {scores_sql()}, cov AS (SELECT d.source, d.doc_id, d.doc_id % 50 AS date, coalesce(n, 0) AS scored FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM sc GROUP BY doc_id) USING (doc_id)), "
       "last AS (SELECT * FROM cov QUALIFY row_number() OVER (PARTITION BY source ORDER BY date DESC, doc_id) = 1), asked AS (SELECT DISTINCT source FROM documents WHERE doc_id % 7 = 0 UNION SELECT 'src99') "
       "SELECT source, doc_id, scored, doc_id IS NULL AS missing, coalesce(scored <= 50, false) AS low_coverage FROM asked LEFT JOIN last USING (source)")
def f13_latest_report(spark: SparkSession, sf: str) -> DataFrame:
    cov = covered(spark, sf).select("source", "doc_id", (F.col("doc_id") % 50).alias("date"), "scored")
    d = table(spark, sf, "documents").select("source", "doc_id")
    asked = d.where("doc_id % 7 = 0").select("source").distinct().unionByName(d.limit(1).select(F.lit("src99").alias("source")))
    return documents.latest_report(cov, asked, "source", "date").select("source", "doc_id", "scored", "missing", "low_coverage")


@query(f"WITH {LATEST} SELECT {BL} FROM bl")
def s9_baseline_store(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    src.save_baseline(latest_baseline(spark, sf), path)
    return _flat(src.load_baseline(spark, path))


ANALYSES = (
    DOCS + TOP.removeprefix(scores_sql()) + TALLY.removeprefix(scores_sql()) + f""", {c.RECORDS},
cover AS (SELECT doc_id, count(*) AS scored, count(*) FILTER ({ANY_HIT}) AS scored_with_hits FROM sc GROUP BY doc_id),
terms AS (SELECT doc_id, string_agg(dimension || ':' || term || '=' || count, ',' ORDER BY dimension, rank) AS terms FROM tally GROUP BY doc_id),
tops AS (SELECT doc_id, string_agg(CAST(sent_id AS VARCHAR), ',' ORDER BY rank) AS top_sentences FROM top GROUP BY doc_id)"""
)


@query(f"WITH {ANALYSES} SELECT doc_id, r.form_type, ds.growth, ds.risk, ds.cost_pressure, ds.net_operating_signal, coalesce(scored, 0) AS scored, coalesce(scored_with_hits, 0) AS scored_with_hits, coalesce(terms, '') AS terms, "
       "coalesce(top_sentences, '') AS top_sentences FROM records r JOIN ds USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN terms USING (doc_id) LEFT JOIN tops USING (doc_id)")
def s6_nested_analyses(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    rows = c.records(spark, sf).select("doc_id", "ticker", "form_type", "filing_date")
    src.write_signals(documents.analyses(rows.join(scored_documents(spark, sf).drop("source"), "doc_id")), path)
    back = spark.read.parquet(path)
    scores = [(F.col(f"scores.{x}") + 0.0).alias(x) for x in ("growth", "risk", "cost_pressure", "net_operating_signal")]
    terms = F.transform("tallies", lambda x: F.concat(x["dimension"], F.lit(":"), x["term"], F.lit("="), x["count"].cast("string")))
    return back.select(
        "doc_id", "form_type", *scores, "coverage.scored", "coverage.scored_with_hits", F.array_join(terms, ",").alias("terms"),
        F.array_join("top_sentences.sent_id", ",").alias("top_sentences"),
    )
