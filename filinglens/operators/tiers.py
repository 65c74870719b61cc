"""Tiered classification (rows H1-H16). A costly tier sees only the rows that the tier before left open: filter, score, union."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import text as t
from .scoring import has_hit

#: How a label may have come about.
METHODS = ["lexicon", "embedding", "llm", "llm_pending", "pending"]
WORD = r"(?U)\b\w\w+\b"


def route_tiers(scored: DataFrame) -> DataFrame:
    """``method`` lexicon and a label where a hit list isn't empty, else pending with zero scores and neutral."""
    hit = has_hit()
    zero = {c: F.when(hit, F.col(c)).otherwise(0.0) for c in ("growth", "risk", "cost_pressure", "net_score")}
    label = F.when(hit, t.net_label(F.col("net_score"))).otherwise("neutral")
    return scored.withColumns({"method": F.when(hit, "lexicon").otherwise("pending"), "label": label, **zero})


def split_tiers(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return routed.where("method <> 'pending'"), routed.where("method = 'pending'")


def fit_idf(texts: DataFrame, text: str = "text", max_features: int = 10_000, word: str = WORD) -> DataFrame:
    """(word, df, tf, idf): smooth idf ln((1 + n) / (1 + df)) + 1 of the most frequent words of two characters or more. A text is cut once and
    its words counted inside the row; what is shuffled are partial sums a word."""
    found = t.counted(F.sort_array(F.regexp_extract_all(F.lower(text), F.lit(word), F.lit(0))))
    n = texts.agg(F.count(F.lit(1)).alias("n_docs"))
    words = texts.select(F.inline(found)).groupBy(F.col("value").alias("word")).agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))
    top = words.orderBy(F.desc("tf"), "word").limit(max_features)
    return top.crossJoin(F.broadcast(n)).select("word", "df", "tf", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # n is one row


def idf_weighted_pool(token_vectors: DataFrame, idf: DataFrame | None, key: str = "id") -> DataFrame:
    """(key, vector): sum(w v) / sum(w) over the tokens (key, word, vector) of a sentence; w is the word's idf, else 1. One vector aggregate:
    a task hands on one vector a group."""
    tv = token_vectors.where(F.col("vector").isNotNull()).withColumn("w", F.lit(1.0))
    if idf is not None:
        tv = tv.drop("w").join(idf.select("word", F.col("idf").alias("w")), "word", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    vector = array_to_vector(F.col("vector").cast("array<double>"))
    return tv.groupBy(key).agg(vector_to_array(Summarizer.mean(vector, F.col("w"))).alias("vector"))


def train_classifier(data: DataFrame, C: float = 1.0, features: str = "vector", label: str = "label_id", max_iter: int = 100) -> LogisticRegressionModel:
    """Multinomial logistic regression with an L2 penalty of 1 / (C n)."""
    n = max(1, data.count())
    rows = data.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(
        family="multinomial", regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    ).fit(rows)


def classify(df: DataFrame, model: LogisticRegressionModel, features: str = "vector", names: list[str] | None = None) -> DataFrame:
    """``label``, ``confidence`` and ``net_score`` = p(positive) - p(negative), rounded to 4."""
    names = names or d.LABELS
    f, p = "_features", F.col("_p")
    scored = model.setFeaturesCol(f).transform(df.withColumn(f, array_to_vector(F.col(features).cast("array<double>"))))
    out = scored.withColumn("_p", vector_to_array("probability"))
    best = F.array_position(p, F.array_max(p)).cast("int")
    return out.withColumns({
        "label": F.element_at(F.array(*[F.lit(x) for x in names]), best), "confidence": F.round(F.array_max(p), 4),
        "net_score": F.round(p[names.index("positive")] - p[names.index("negative")], 4),
    }).select(*df.columns, "label", "confidence", "net_score")


def escalate(df: DataFrame, threshold: float = 0.60, last_tier: bool = False) -> DataFrame:
    """Rows of the classifier under the threshold go to the last tier, if there is one; else they are accepted."""
    low = F.col("confidence") < threshold
    return df.withColumn("method", F.when(low & F.lit(last_tier), "llm_pending").otherwise("embedding"))


def make_batches(pending: DataFrame, size: int = 10, key: str = "doc_id", order: str = "sent_id") -> tuple[DataFrame, DataFrame]:
    """(members, prompts): pending sentences numbered within their document, batches of ``size``, and each batch's prompt."""
    rn = F.row_number().over(W.partitionBy(key).orderBy(order))
    m = pending.withColumn("_rn", rn).withColumn("batch", F.floor((F.col("_rn") - 1) / size).cast("int"))
    m = m.withColumn("n", ((F.col("_rn") - 1) % size + 1).cast("int")).drop("_rn")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["text"]))
    return m, m.groupBy(key, "batch").agg(F.array_join(lines, "\n").alias("prompt"))


def _lines(responses: DataFrame, keys: list[str]) -> DataFrame:
    """The lines that aren't blank and their parts, which are cut once: filters on what is read from them would else cut them again each."""
    rows = responses.select(*keys, F.posexplode(F.split("response_text", "\n", -1)).alias("pos", "line")).where(F.trim("line") != "")
    return rows.select("*", F.explode(F.array(F.transform(F.split("line", r"\|", -1), lambda x: F.trim(x)))).alias("parts"))


def parse_responses(members: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """Members with ``label`` and ``reason`` of the last valid line n|label|reason of their batch; none: neutral, parse_error."""
    rows = _lines(responses, keys).where(F.size("parts") >= 3)
    rows = rows.select(*keys, "pos", F.col("parts")[0].try_cast("int").alias("n"), F.lower(F.col("parts")[1]).alias("label"), F.col("parts")[2].alias("reason"))
    last = rows.where(F.col("label").isin(d.LABELS) & F.col("n").isNotNull()).groupBy(*keys, "n").agg(
        F.max_by(F.struct("label", "reason"), "pos").alias("r")
    )
    out = members.join(last, [*keys, "n"], "left")
    return out.withColumn("label", F.coalesce("r.label", F.lit("neutral"))).withColumn("reason", F.coalesce("r.reason", F.lit("parse_error"))).drop("r")


def parse_scored_responses(members: DataFrame, responses: DataFrame, keys: list[str]) -> DataFrame:
    """n|label|score|reason: bad labels are neutral, scores clamped to [-1, 1]; growth and risk are its two sides."""
    rows = _lines(responses, keys).where(F.size("parts") >= 4)
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("parts")[2].try_cast("double")))
    label = F.lower(F.col("parts")[1])
    rows = rows.select(*keys, "pos", F.col("parts")[0].try_cast("int").alias("n"), F.when(label.isin(d.LABELS), label).otherwise("neutral").alias("label"),
                       score.alias("score"), F.col("parts")[3].alias("reason"))
    last = rows.where("n IS NOT NULL AND score IS NOT NULL").groupBy(*keys, "n").agg(F.max_by(F.struct("label", "score", "reason"), "pos").alias("r"))
    out = members.join(last, [*keys, "n"], "left")
    net = F.coalesce("r.score", F.lit(0.0))
    return out.withColumns({
        "label": F.coalesce("r.label", F.lit("neutral")), "net_score": net, "growth": F.greatest(net, F.lit(0.0)), "risk": F.greatest(-net, F.lit(0.0)),
        "reason": F.coalesce("r.reason", F.lit("parse_error")),
    }).drop("r")


def api_error_fallback(members: DataFrame, parsed: DataFrame, failed: DataFrame, keys: list[str]) -> DataFrame:
    """Members of failed batches become neutral with reason api_error; the others are as parsed."""
    lost = members.join(failed.select(*keys).distinct(), keys, "left_semi")
    cols = parsed.columns
    lost = lost.withColumns({"label": F.lit("neutral"), "reason": F.lit("api_error")})
    rest = parsed.join(failed.select(*keys).distinct(), keys, "left_anti")
    return rest.unionByName(lost.select(*[c if c in lost.columns else F.lit(None).cast(parsed.schema[c].dataType).alias(c) for c in cols]))


def merge_tiers(decided: DataFrame, answered: DataFrame, keys: list[str], split_sides: bool = False) -> DataFrame:
    """Answers replace the pending rows: net is +1, 0 or -1 by label. Growth and risk of those stay 0 unless ``split_sides``."""
    a = answered.select(*keys, F.col("label").alias("_label"), F.lit(True).alias("_hit"))
    net = F.when(F.col("_label") == "positive", 1.0).when(F.col("_label") == "negative", -1.0).otherwise(0.0)
    out = decided.join(a, keys, "left")
    new = {"label": F.coalesce("_label", "label"), "net_score": F.when(F.col("_hit"), net).otherwise(F.col("net_score")),
           "method": F.when(F.col("_hit"), "llm").otherwise(F.col("method"))}
    if split_sides:
        new |= {"growth": F.when(F.col("_hit"), F.greatest(net, F.lit(0.0))).otherwise(F.col("growth")),
                "risk": F.when(F.col("_hit"), F.greatest(-net, F.lit(0.0))).otherwise(F.col("risk"))}
    return out.withColumns(new).drop("_label", "_hit")


def tier_stats(rows: DataFrame) -> DataFrame:
    """(method, n, negative, neutral, positive, pct)."""
    counts = [F.count_if(F.col("label") == x).alias(x) for x in d.LABELS]
    return _with_shares(rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), *counts))


def _with_shares(per: DataFrame) -> DataFrame:
    return per.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1))  # a window over one row a method


def observe_tiers(rows: DataFrame, methods: list[str] = METHODS) -> tuple[DataFrame, Observation]:
    """``rows`` that count themselves by method and label in whatever pass writes them; ``observed_stats`` reads the counts then."""
    seen = Observation("tiers")
    counts = [F.count_if((F.col("method") == m) & (F.col("label") == x)).alias(f"{m} {x}") for m in methods for x in d.LABELS]
    return rows.observe(seen, *counts), seen


def observed_stats(spark: SparkSession, seen: Observation, methods: list[str] = METHODS) -> DataFrame:
    """The rows of ``tier_stats`` for rows that have been written, without another scan."""
    found = seen.get
    rows = [(m, *[found[f"{m} {x}"] for x in d.LABELS]) for m in methods]
    schema = ", ".join(["method string", *[f"{x} long" for x in d.LABELS]])
    per = spark.createDataFrame([r for r in rows if any(r[1:])], schema).withColumn("n", sum((F.col(x) for x in d.LABELS[1:]), F.col(d.LABELS[0])))
    return _with_shares(per.select("method", "n", *d.LABELS))


def normalize_row(rows: DataFrame) -> DataFrame:
    """Rows that a lexicon didn't score get growth and risk from the sides of their net score."""
    other = ~F.col("method").isin("lexicon")
    return rows.withColumns({
        "growth": F.when(other, F.greatest("net_score", F.lit(0.0))).otherwise(F.col("growth")),
        "risk": F.when(other, F.greatest(-F.col("net_score"), F.lit(0.0))).otherwise(F.col("risk")),
    })


def hybrid_rescore(rows: DataFrame, cap: int | None = None, key: str = "doc_id", order: str = "sent_id") -> DataFrame:
    """One row a document over its first ``cap`` sentences: means, label counts and coverage of lexicon and both tiers."""
    if cap is not None:
        rows = rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("_rn") <= cap).drop("_rn")
    hit, answered = F.col("method") == "lexicon", (F.col("method") == "llm") & (F.col("label") != "neutral")
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(
        n.alias("n"), *[t.exact_mean(c).alias(c) for c in ("growth", "risk", "cost_pressure")],
        *[F.count_if(F.col("label") == x).alias(x) for x in d.LABELS],
        F.round(F.count_if(hit) / n, 4).alias("lexicon_coverage"), F.round((F.count_if(hit) + F.count_if(answered)) / n, 4).alias("hybrid_coverage"),
    )


def response_only_rescore(rows: DataFrame, cap: int | None = None, key: str = "doc_id", order: str = "sent_id") -> DataFrame:
    """The same without a lexicon tier: coverage is the share of answers that aren't neutral."""
    out = hybrid_rescore(rows.withColumn("method", F.lit("llm")), cap, key, order)
    return out.drop("lexicon_coverage").withColumnRenamed("hybrid_coverage", "response_coverage")


def rescore_view(rows: DataFrame, rescored: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_answered, coverage_boost): rows of the response tier, and what it adds to coverage (0 at least)."""
    n = rows.where("method = 'llm'").groupBy(key).agg(F.count(F.lit(1)).alias("n_answered"))
    boost = F.greatest(F.col("hybrid_coverage") - F.col("lexicon_coverage"), F.lit(0.0))
    return rescored.join(n, key, "left").select(key, F.coalesce("n_answered", F.lit(0)).alias("n_answered"), F.round(boost, 4).alias("coverage_boost"))


def tiered(scored: DataFrame, *tiers: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Each tier takes the rows that are still pending; what it leaves pending goes to the next. ``cut`` is put on the routed rows and on each
    tier's answers: one that writes them keeps a tier from running again for each of the two ways that its rows go."""
    done, open_ = split_tiers(cut(route_tiers(scored)))
    for tier in tiers:
        answered, left = split_tiers(cut(tier(open_)))
        done, open_ = done.unionByName(answered, allowMissingColumns=True), left
    return done.unionByName(open_, allowMissingColumns=True)
