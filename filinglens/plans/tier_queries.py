"""Queries of the tiered classifier and of evaluation (rows H, I)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import scoring, tiers
from .corpus import Query, mean_s, once, r4, r4s, scored, scored_first, scores_sql, table
from .records_queries import labelled_items
from .scoring_queries import ANY_HIT

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


ROUTED = scores_sql() + f""",
rt AS (SELECT doc_id, sent_id, text, CASE WHEN {ANY_HIT} THEN 'lexicon' ELSE 'pending' END AS method,
 CASE WHEN NOT ({ANY_HIT}) THEN 'neutral' WHEN net_score > 0.1 THEN 'positive' WHEN net_score < -0.1 THEN 'negative' ELSE 'neutral' END AS label,
 CASE WHEN {ANY_HIT} THEN growth ELSE 0 END AS growth, CASE WHEN {ANY_HIT} THEN risk ELSE 0 END AS risk, CASE WHEN {ANY_HIT} THEN cost_pressure ELSE 0 END AS cost_pressure,
 CASE WHEN {ANY_HIT} THEN net_score ELSE 0 END AS net_score FROM sc)"""


def routed(spark: SparkSession, sf: str, prompts: bool = False) -> DataFrame:
    """Scored and routed sentences, computed once for all the steps that follow; with the texts of the pending ones, if ``prompts`` are made."""
    cols = ["doc_id", "sent_id", "text", "method", "label", "growth", "risk", "cost_pressure", "net_score"]
    rows = tiers.route_tiers(scored(spark, sf)).select(cols)
    return once(rows.withColumn("text", F.when(F.col("method") == "pending", F.col("text"))) if prompts else rows.drop("text"))


@query(f"WITH {ROUTED} SELECT doc_id, sent_id, method, label, {r4s('net_score')} FROM rt")
def h1_route_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.route_tiers(scored(spark, sf)).select("doc_id", "sent_id", "method", "label", r4("net_score"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]{2,}') AS ws FROM documents), tf AS (SELECT word, count(*) AS tf FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS word FROM w) GROUP BY word)
SELECT word, df, tf, round(ln((1 + (SELECT count(*) FROM w)) / (1 + df)::DOUBLE) + 1, 6) AS idf FROM tf JOIN df USING (word) ORDER BY tf DESC, word LIMIT 10000""")
def h2_fit_idf(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.fit_idf(table(spark, sf, "documents"), word="[\\p{L}\\p{N}]{2,}").withColumn("idf", F.round("idf", 6))


@query("""WITH tv AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim, coalesce(1 + r_regionkey * 0.5::DOUBLE, 1.0::DOUBLE) AS w
 FROM embeddings LEFT JOIN region ON r_regionkey = vec_id % 7) SELECT label AS id, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 6) + 0.0 AS x FROM tv GROUP BY label, dim""")
def h3_idf_weighted_pool(spark: SparkSession, sf: str) -> DataFrame:
    tv = table(spark, sf, "embeddings").select(F.col("label").alias("id"), F.concat(F.lit("w"), (F.col("vec_id") % 7).cast("string")).alias("word"), F.col("embedding").cast("array<double>").alias("vector"))
    idf = table(spark, sf, "region").select(F.concat(F.lit("w"), F.col("r_regionkey").cast("string")).alias("word"), (F.col("r_regionkey") * 0.5 + 1).alias("idf"))
    pooled = tiers.idf_weighted_pool(tv, idf).select("id", F.posexplode("vector").alias("dim", "x"))
    return pooled.select("id", "dim", (F.round("x", 6) + 0.0).alias("x"))


def class_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    return v.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 3).alias("label_id"))


@query()
def h4_train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    data = class_vectors(spark, sf)
    out = tiers.classify(data, tiers.train_classifier(data, 1.0))
    return out.select("vec_id", "label_id", "label", "confidence", "net_score")


@query()
def h5_classify(spark: SparkSession, sf: str) -> DataFrame:
    data = class_vectors(spark, sf)
    out = tiers.classify(data, tiers.train_classifier(data.where("vec_id % 4 <> 0"), 0.1, max_iter=50))
    return out.select("vec_id", (F.col("vec_id") % 4 == 0).alias("held_out"), "label", "confidence", "net_score")


@query("SELECT vec_id, CASE WHEN (vec_id % 100) / 100.0::DOUBLE < 0.6::DOUBLE THEN 'llm_pending' ELSE 'embedding' END AS method FROM embeddings")
def h6_escalate(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", ((F.col("vec_id") % 100) / 100.0).alias("confidence"))
    return tiers.escalate(v, 0.6, True).select("vec_id", "method")


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors by a model of three quarters of them, each row with its true label."""
    data = class_vectors(spark, sf)
    names = F.array(*[F.lit(x) for x in ("negative", "neutral", "positive")])
    data = data.withColumn("true_label", F.element_at(names, F.col("label_id").cast("int") + 1))
    return tiers.classify(data, tiers.train_classifier(data.where("vec_id % 4 <> 0"), 0.1, max_iter=50))


@query()
def h6_escalate_classified(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of which the classifier itself isn't sure go to the last tier."""
    return tiers.escalate(classified(spark, sf), 0.6, True).select("vec_id", "label", "confidence", "method")


BATCHED = ROUTED + """,
mem AS (SELECT doc_id, sent_id, text, CAST((rn - 1) // 10 AS INTEGER) AS batch, CAST((rn - 1) % 10 + 1 AS INTEGER) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) AS rn FROM rt WHERE method = 'pending'))"""


def batches(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    _, pending = tiers.split_tiers(rows)
    return tiers.make_batches(pending)


@query(f"WITH {BATCHED} SELECT doc_id, batch, string_agg(n || '. ' || text, chr(10) ORDER BY n) AS prompt FROM mem GROUP BY doc_id, batch")
def h7_make_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches(routed(spark, sf, prompts=True))[1]


#: What a model might answer: a label by number, one in seven lines broken, one number answered twice.
ANSWER = "CASE (doc_id + n) % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' ELSE 'unsure' END"
ANSWERED = BATCHED + f""",
ans AS (SELECT *, CASE WHEN (doc_id + sent_id) % 7 = 0 THEN NULL WHEN {ANSWER} = 'unsure' THEN NULL ELSE lower({ANSWER}) END AS lab FROM mem)"""


def answers(rows: DataFrame, score: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pending sentences with their numbers (doc_id, sent_id, batch, n), written once for all that joins them, and a response for each batch."""
    m = once(batches(rows.withColumn("text", F.lit("")))[0].select("doc_id", "sent_id", "batch", "n"))
    k = (F.col("doc_id") + F.col("n")) % 4
    label = F.when(k == 0, "Positive").when(k == 1, "negative").when(k == 2, "neutral").otherwise("unsure")
    number = F.col("n").cast("string")
    middle = F.concat(label, F.lit(" | "), ((F.col("doc_id") % 5 - 2) * 0.75).cast("string")) if score else label
    line = F.when((F.col("doc_id") + F.col("sent_id")) % 7 == 0, F.concat(F.lit("no. "), number)).otherwise(F.concat(F.lit(" "), number, F.lit("|"), middle, F.lit("|because ")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"])
    return m, m.groupBy("doc_id", "batch").agg(F.concat(F.lit("1|positive|0.1|early\n1|neutral|0|early\n"), F.array_join(lines, "\n")).alias("response_text"))


KEYS = ["doc_id", "batch"]


@query(f"WITH {ANSWERED} SELECT doc_id, sent_id, coalesce(lab, CASE WHEN n = 1 THEN 'neutral' END, 'neutral') AS label, CASE WHEN lab IS NOT NULL THEN 'because' WHEN n = 1 THEN '0' ELSE 'parse_error' END AS reason FROM ans")
def h8_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    m, r = answers(routed(spark, sf))
    return tiers.parse_responses(m, r, KEYS).select("doc_id", "sent_id", "label", "reason")


@query(f"""WITH {BATCHED}, sc2 AS (SELECT *, (doc_id + sent_id) % 7 <> 0 AS ok, greatest(-1.0, least(1.0, (doc_id % 5 - 2) * 0.75)) AS s FROM mem)
SELECT doc_id, sent_id, CASE WHEN ok THEN CASE WHEN {ANSWER} = 'unsure' THEN 'neutral' ELSE lower({ANSWER}) END ELSE 'neutral' END AS label, CAST(CASE WHEN ok THEN s ELSE 0 END AS DOUBLE) + 0.0 AS net_score,
 CAST(CASE WHEN ok THEN greatest(s, 0) ELSE 0 END AS DOUBLE) + 0.0 AS growth, CAST(CASE WHEN ok THEN greatest(-s, 0) ELSE 0 END AS DOUBLE) + 0.0 AS risk FROM sc2""")
def h9_parse_scored_responses(spark: SparkSession, sf: str) -> DataFrame:
    m, r = answers(routed(spark, sf), score=True)
    out = tiers.parse_scored_responses(m, r, KEYS)
    return out.select("doc_id", "sent_id", "label", *[(F.col(x) + 0.0).alias(x) for x in ("net_score", "growth", "risk")])


@query(f"WITH {ANSWERED} SELECT doc_id, sent_id, CASE WHEN doc_id % 3 = 0 THEN 'neutral' ELSE coalesce(lab, 'neutral') END AS label, CASE WHEN doc_id % 3 = 0 THEN 'api_error' WHEN lab IS NOT NULL THEN 'because' WHEN n = 1 THEN '0' ELSE 'parse_error' END AS reason FROM ans")
def h10_api_error_fallback(spark: SparkSession, sf: str) -> DataFrame:
    m, r = answers(routed(spark, sf))
    parsed = tiers.parse_responses(m, r, KEYS)
    return tiers.api_error_fallback(m, parsed, r.where("doc_id % 3 = 0"), KEYS).select("doc_id", "sent_id", "label", "reason")


MERGED = ANSWERED + """,
mg AS (SELECT rt.doc_id, rt.sent_id, rt.text, coalesce(a.label, rt.label) AS label, CASE WHEN a.label IS NULL THEN rt.method ELSE 'llm' END AS method,
 CASE a.label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 ELSE rt.net_score END AS net_score, rt.growth, rt.risk, rt.cost_pressure
 FROM rt LEFT JOIN (SELECT doc_id, sent_id, coalesce(lab, 'neutral') AS label FROM ans) a USING (doc_id, sent_id))"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = routed(spark, sf)
    m, r = answers(rows)
    return tiers.merge_tiers(rows, tiers.parse_responses(m, r, KEYS), ["doc_id", "sent_id"])


@query(f"WITH {MERGED} SELECT doc_id, sent_id, label, method, {r4s('net_score')} FROM mg")
def h11_merge_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return merged(spark, sf).select("doc_id", "sent_id", "label", "method", r4("net_score"))


@query(f"WITH {MERGED} SELECT method, count(*) AS n, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM mg GROUP BY method")
def h12_tier_stats(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.tier_stats(merged(spark, sf))


FLOW = scores_sql() + f""",
f1 AS (SELECT doc_id, sent_id, len(tk) AS n_tokens, CASE WHEN {ANY_HIT} THEN 'lexicon' WHEN len(tk) % 10 >= 6 THEN 'embedding' ELSE 'pending' END AS method,
 CASE WHEN {ANY_HIT} THEN CASE WHEN net_score > 0.1 THEN 'positive' WHEN net_score < -0.1 THEN 'negative' ELSE 'neutral' END
 ELSE CASE len(tk) % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END END AS label FROM sc),
f2 AS (SELECT *, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1) % 10 + 1 AS INTEGER) AS n FROM f1 WHERE method = 'pending'),
fl AS (SELECT method, label FROM f1 WHERE method <> 'pending' UNION ALL SELECT 'llm', CASE WHEN (doc_id + sent_id) % 7 = 0 OR {ANSWER} = 'unsure' THEN 'neutral' ELSE lower({ANSWER}) END FROM f2)"""


@query(f"WITH {FLOW} SELECT method, count(*) AS n, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'positive') AS positive, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS pct FROM fl GROUP BY method")
def h12_tiered_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Lexicon, a classifier and answers as one flow: each tier sees what the one before left, and the pass that writes the result counts it."""
    def classifier(rows: DataFrame) -> DataFrame:
        n = F.col("n_tokens") % 3
        out = tiers.escalate(rows.withColumn("confidence", (F.col("n_tokens") % 10) / 10.0), 0.6, True)
        label = F.when(n == 0, "negative").when(n == 1, "neutral").otherwise("positive")
        return out.withColumns({"label": label, "method": F.when(F.col("method") == "embedding", "embedding").otherwise("pending")})

    def answered(rows: DataFrame) -> DataFrame:
        m, r = answers(rows)
        return tiers.merge_tiers(rows, tiers.parse_responses(m, r, KEYS), ["doc_id", "sent_id"])

    narrow = ["doc_id", "sent_id", "n_tokens", *scoring.HIT_LISTS, *scoring.SCORES, "net_score"]
    keep = lambda df: once(df.drop(*scoring.HIT_LISTS))
    rows, seen = tiers.observe_tiers(tiers.tiered(scored(spark, sf).select(narrow), classifier, answered, cut=keep))
    once(rows.select("doc_id", "sent_id", "method", "label", "net_score"))
    return tiers.observed_stats(spark, seen)


@query(f"WITH {MERGED} SELECT doc_id, sent_id, method, {r4s("CASE WHEN method = 'lexicon' THEN growth ELSE greatest(net_score, 0) END", 'growth')}, {r4s("CASE WHEN method = 'lexicon' THEN risk ELSE greatest(-net_score, 0) END", 'risk')} FROM mg")
def h13_normalize_row(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.normalize_row(merged(spark, sf)).select("doc_id", "sent_id", "method", r4("growth"), r4("risk"))


RESCORED = MERGED + f""",
hr AS (SELECT doc_id, count(*) AS n, {mean_s('growth')} AS growth, {mean_s('risk')} AS risk, {mean_s('cost_pressure')} AS cost_pressure, count(*) FILTER (label = 'negative') AS negative, count(*) FILTER (label = 'neutral') AS neutral,
 count(*) FILTER (label = 'positive') AS positive, round(count(*) FILTER (method = 'lexicon') / count(*)::DOUBLE, 4) AS lexicon_coverage,
 round((count(*) FILTER (method = 'lexicon') + count(*) FILTER (method = 'llm' AND label <> 'neutral')) / count(*)::DOUBLE, 4) AS hybrid_coverage
 FROM (SELECT * FROM mg QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) <= 20) GROUP BY doc_id)"""


@query(f"WITH {RESCORED} SELECT doc_id, n, {r4s('growth')}, {r4s('risk')}, {r4s('cost_pressure')}, negative, neutral, positive, lexicon_coverage, hybrid_coverage FROM hr")
def h14_hybrid_rescore(spark: SparkSession, sf: str) -> DataFrame:
    out = tiers.hybrid_rescore(merged(spark, sf), 20)
    return out.withColumns({x: F.col(x) + 0.0 for x in ("growth", "risk", "cost_pressure")})


@query(f"WITH {MERGED} SELECT doc_id, count(*) AS n, count(*) FILTER (label = 'positive') AS positive, round(count(*) FILTER (label <> 'neutral') / count(*)::DOUBLE, 4) AS response_coverage FROM mg GROUP BY doc_id")
def h15_response_only_rescore(spark: SparkSession, sf: str) -> DataFrame:
    return tiers.response_only_rescore(merged(spark, sf)).select("doc_id", "n", "positive", "response_coverage")


@query(f"WITH {RESCORED} SELECT hr.doc_id, coalesce(a, 0) AS n_answered, round(greatest(hybrid_coverage - lexicon_coverage, 0), 4) AS coverage_boost FROM hr LEFT JOIN (SELECT doc_id, count(*) AS a FROM mg WHERE method = 'llm' GROUP BY doc_id) USING (doc_id)")
def h16_rescore_view(spark: SparkSession, sf: str) -> DataFrame:
    m = once(merged(spark, sf))
    return tiers.rescore_view(m, tiers.hybrid_rescore(m, 20))


PRED = scores_sql() + """,
it AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS true_label FROM documents JOIN labels USING (doc_id)),
pr AS (SELECT id, true_label, coalesce(net_score, 0) AS net_score, coalesce(growth, 0) AS growth, coalesce(risk, 0) AS risk, coalesce(cost_pressure, 0) AS cost_pressure,
 CASE WHEN net_score > 0.1 THEN 'positive' WHEN net_score < -0.1 THEN 'negative' ELSE 'neutral' END AS pred_label FROM it LEFT JOIN (SELECT * FROM sc WHERE sent_id = 0) s ON s.doc_id = it.id)"""


def items(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*[F.lit(x) for x in ("negative", "neutral", "positive")]), F.col("label") + 1)
    return labelled_items(spark, sf).select("id", label.alias("true_label"))


def first_scored(spark: SparkSession, sf: str, versions: list[str]) -> DataFrame:
    return scored_first(spark, sf, items(spark, sf).select(F.col("id").alias("doc_id")), versions)


def predicted(spark: SparkSession, sf: str, version: str = "v1") -> DataFrame:
    return ev.predict_items(items(spark, sf), first_scored(spark, sf, [version]))


@query(f"WITH {PRED} SELECT id, true_label, pred_label, {r4s('net_score')} FROM pr")
def i1_predict_items(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(spark, sf).select("id", "true_label", "pred_label", r4("net_score"))


GRID = "lab AS (SELECT unnest(['negative', 'neutral', 'positive']) AS x)"


@query(f"WITH {PRED}, {GRID} SELECT a.x AS true_label, b.x AS pred_label, count(id) AS n FROM lab a CROSS JOIN lab b LEFT JOIN pr ON true_label = a.x AND pred_label = b.x GROUP BY a.x, b.x")
def i2_confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(predicted(spark, sf))


def _report_sql(source: str, by: str = "") -> str:
    """Rows of the three labels, macro, weighted and accuracy out of (true_label, pred_label) rows."""
    b = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f""", cnt AS (SELECT {b}x AS label, count(*) FILTER (true_label = x AND pred_label = x) AS tp, count(*) FILTER (pred_label = x) AS said, count(*) FILTER (true_label = x) AS support FROM {source}, lab GROUP BY {b}x),
 per AS (SELECT *, CASE WHEN said = 0 THEN 0 ELSE tp / said::DOUBLE END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support::DOUBLE END AS r, CASE WHEN said + support = 0 THEN 0 ELSE 2 * tp / (said + support)::DOUBLE END AS f FROM cnt),
 acc AS (SELECT {b}count(*) FILTER (true_label = pred_label) / count(*)::DOUBLE AS a, count(*) AS n FROM {source} {group}),
 rep AS (SELECT {b}label, p, r, f, support FROM per UNION ALL SELECT {b}'macro', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM per {group}
 UNION ALL SELECT {b}'weighted', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per {group}
 UNION ALL SELECT {b}'accuracy', a, a, a, n FROM acc)
 SELECT {b}label, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM rep"""


@query(f"WITH {PRED}, {GRID}{_report_sql('pr')}")
def i3_classification_report(spark: SparkSession, sf: str) -> DataFrame:
    return ev.classification_report(predicted(spark, sf))


_SWEEP = "sw AS (SELECT threshold, true_label, CASE WHEN net_score > threshold THEN 'positive' WHEN net_score < -threshold THEN 'negative' ELSE 'neutral' END AS pred_label FROM pr, (SELECT unnest([0.0::DOUBLE, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5]) AS threshold))"


@query(f"WITH {PRED}, {GRID}, {_SWEEP}{_report_sql('sw', 'threshold')}")
def i4_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return ev.threshold_sweep(predicted(spark, sf))


@query(f"WITH {PRED} SELECT count(*) AS n, count(*) FILTER (growth <> 0 OR risk <> 0 OR cost_pressure <> 0) AS with_signal, round(count(*) FILTER (growth <> 0 OR risk <> 0 OR cost_pressure <> 0) / count(*)::DOUBLE, 4) AS coverage, "
       "count(*) FILTER (pred_label = 'neutral') - count(*) FILTER (true_label = 'neutral') AS neutral_inflation FROM pr")
def i5_signal_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ev.signal_coverage(predicted(spark, sf))


def methods(wanted: DataFrame, first: DataFrame, version: str) -> DataFrame:
    """Predictions of one engine version and how each came about; ``first`` are the scored first sentences of all versions."""
    parsed, first = F.col("parsed"), first.where(F.col("engine_version") == version)
    p = ev.predict_items(wanted, first)
    seen = first.select(F.col("doc_id").alias("id"), F.lit(True).alias("parsed"), scoring.has_hit().alias("hit"))
    p = p.join(seen, "id", "left").withColumns({"parsed": F.coalesce("parsed", F.lit(False)), "hit": F.coalesce("hit", F.lit(False))})
    return p.withColumn("method", ev.miss_method(version, parsed, F.col("hit"))).withColumn("engine", F.lit(version))


def _engine_sql(v: str) -> str:
    """(id, true_label, pred_label, method, engine) of one engine version."""
    method = "CASE WHEN s.doc_id IS NOT NULL AND (growth <> 0 OR risk <> 0) THEN 'lexicon' ELSE 'lexicon_miss' END" if v == "v1" else f"CASE WHEN s.doc_id IS NULL OR {ANY_HIT} THEN 'lexicon' ELSE 'lexicon_miss' END"
    return f"""(WITH {scores_sql(v)}, it AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS true_label FROM documents JOIN labels USING (doc_id))
 SELECT id, true_label, CASE WHEN net_score > 0.1 THEN 'positive' WHEN net_score < -0.1 THEN 'negative' ELSE 'neutral' END AS pred_label, {method} AS method, '{v}' AS engine FROM it LEFT JOIN (SELECT * FROM sc WHERE sent_id = 0) s ON s.doc_id = it.id)"""


ENGINES = f"en AS (SELECT * FROM {_engine_sql('v1')} UNION ALL SELECT * FROM {_engine_sql('v2')})"


def engines(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "true_label", "pred_label", "method", "engine"]
    wanted, first = items(spark, sf), once(first_scored(spark, sf, ["v1", "v2"]))
    return methods(wanted, first, "v1").select(cols).unionByName(methods(wanted, first, "v2").select(cols))


@query(f"WITH {ENGINES}, m AS (SELECT engine, method, count(*) AS n FROM en GROUP BY ALL) SELECT engine, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(CASE WHEN method = 'lexicon' THEN n ELSE 0 END) / sum(n)::DOUBLE, 4) AS coverage, string_agg(method || '=' || n, ',' ORDER BY method) AS breakdown FROM m GROUP BY engine")
def i6_method_coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.method_coverage(engines(spark, sf), ["engine"])
    flat = F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumn("breakdown", flat)


@query(f"WITH {PRED} SELECT id, true_label, pred_label FROM pr WHERE true_label <> pred_label ORDER BY id LIMIT 30")
def i7_error_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ev.error_sample(predicted(spark, sf)).select("id", "true_label", "pred_label")


SPLIT = """it AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS true_label FROM documents JOIN labels USING (doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY md5(id || '|42'), id) AS k, count(*) OVER (PARTITION BY true_label) AS n FROM it),
sp AS (SELECT id, true_label, CASE WHEN k <= floor(n * 0.7::DOUBLE + 0.5) THEN 'train' WHEN k <= floor(n * (0.7::DOUBLE + 0.15::DOUBLE) + 0.5) THEN 'val' ELSE 'test' END AS split FROM rk)"""


@query(f"WITH {SPLIT} SELECT * FROM sp")
def i8_stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return ev.stratified_split(items(spark, sf))


@query(f"WITH {SPLIT} SELECT split, count(*) FILTER (true_label = 'negative') AS negative, count(*) FILTER (true_label = 'neutral') AS neutral, count(*) FILTER (true_label = 'positive') AS positive FROM sp GROUP BY split")
def i9_class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return ev.class_distribution(ev.stratified_split(items(spark, sf)))


@query()
def i10_tune_c(spark: SparkSession, sf: str) -> DataFrame:
    data = class_vectors(spark, sf).withColumn("true_label", F.element_at(F.array(*[F.lit(x) for x in ("negative", "neutral", "positive")]), F.col("label_id") + 1))
    split = ev.stratified_split(data, key="vec_id")
    return ev.tune_c(split.where("split = 'train'"), split.where("split = 'val'"))[1]


@query(f"WITH {PRED}, {GRID}, tt AS (SELECT threshold, true_label, CASE WHEN (id % 100) / 100.0::DOUBLE < threshold THEN 'neutral' ELSE pred_label END AS pred_label FROM pr, (SELECT unnest([0.5::DOUBLE, 0.55, 0.6, 0.65, 0.7]) AS threshold)){_report_sql('tt', 'threshold')}")
def i11_tune_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return ev.tune_threshold(predicted(spark, sf).withColumn("confidence", (F.col("id") % 100) / 100.0), last_tier=True)


@query()
def i11_tune_classified(spark: SparkSession, sf: str) -> DataFrame:
    """The report at each confidence of the classifier, on the vectors that it hasn't seen."""
    held = classified(spark, sf).where("vec_id % 4 = 0").select("true_label", F.col("label").alias("pred_label"), "confidence")
    return ev.tune_threshold(held, last_tier=True)


@query(f"WITH {ENGINES}, {GRID}{_report_sql('en', 'engine').rsplit('SELECT engine, label, round', 1)[0]}, cv AS (SELECT engine, round(count(*) FILTER (method = 'lexicon') / count(*)::DOUBLE, 4) AS coverage FROM en GROUP BY engine) SELECT engine, round(max(f) FILTER (label = 'accuracy'), 4) AS accuracy, round(max(f) FILTER (label = 'macro'), 4) AS macro_f1, round(max(f) FILTER (label = 'weighted'), 4) AS weighted_f1, any_value(coverage) AS coverage FROM rep JOIN cv USING (engine) GROUP BY engine")
def i12_engine_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return ev.engine_comparison(engines(spark, sf))


@query(f"WITH {ENGINES} SELECT id, engine, method FROM en")
def i13_miss_semantics(spark: SparkSession, sf: str) -> DataFrame:
    return engines(spark, sf).select("id", "engine", "method")

