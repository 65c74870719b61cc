"""Evaluation (rows I1-I13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import text as t
from . import logistic
from .ranks import buckets_for, free_name, ranked, unit_hash


def predict_items(items: DataFrame, scored: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Items (id, true_label) by the score of their first sentence (sent_id 0); unscored ones are neutral with net 0."""
    first = scored.where("sent_id = 0").select(F.col("doc_id").alias("id"), "net_score", "growth", "risk", "cost_pressure")
    out = items.join(first, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("net_score", "growth", "risk", "cost_pressure")}
    return out.withColumns(zero).withColumn("pred_label", t.net_label(F.col("net_score"), threshold))


def _label_grid(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(a, b) for a in labels for b in labels], "true_label string, pred_label string")


def confusion_matrix(pred: DataFrame, labels: list[str] = d.LABELS) -> DataFrame:
    """(true_label, pred_label, n) for every pair of labels, zero cells kept."""
    n = pred.groupBy("true_label", "pred_label").agg(F.count(F.lit(1)).alias("n"))
    return _label_grid(pred, labels).join(n, ["true_label", "pred_label"], "left").select("true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(pred: DataFrame, by: list[str] | None = None, labels: list[str] = d.LABELS) -> DataFrame:
    """(by, label, precision, recall, f1, support) with rows macro, weighted and accuracy (in f1); 0 where nothing is divided by.

    One aggregate counts everything; the rest is arithmetic on a few rows of each group.
    """
    by = by or []
    true, said = F.col("true_label"), F.col("pred_label")
    counts = [F.struct(F.lit(x).alias("label"), F.count_if((true == x) & (said == x)).alias("tp"), F.count_if(said == x).alias("said"), F.count_if(true == x).alias("support")) for x in labels]
    per = pred.groupBy(*by).agg(F.array(*counts).alias("c"), F.count(F.lit(1)).alias("n"), F.count_if(true == said).alias("right"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    scored = per.withColumn("c", F.transform("c", lambda x: F.struct(
        x["label"].alias("label"), div(x["tp"], x["said"]).alias("precision"), div(x["tp"], x["support"]).alias("recall"),
        div(2 * x["tp"], x["said"] + x["support"]).alias("f1"), x["support"].alias("support"),
    )))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["support"])
    mean = lambda f: F.aggregate("c", F.lit(0.0), lambda a, x: a + x[f]) / len(labels)
    wmean = lambda f: div(F.aggregate("c", F.lit(0.0), lambda a, x: a + x[f] * x["support"]), total)
    row = lambda name, p, r, f: F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), total.alias("support"))
    acc = div(F.col("right"), F.col("n"))
    extra = F.array(row("macro", *[mean(x) for x in ("precision", "recall", "f1")]), row("weighted", *[wmean(x) for x in ("precision", "recall", "f1")]), row("accuracy", acc, acc, acc))
    out = scored.select(*by, F.inline(F.concat("c", extra)))
    return out.withColumns({c: F.round(c, 4) for c in ("precision", "recall", "f1")})


def threshold_sweep(pred: DataFrame, thresholds: list[float] = d.SWEEP_THRESHOLDS) -> DataFrame:
    """The report at each label threshold: every row meets the few thresholds in place, and one shuffle counts them all."""
    rows = pred.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    return classification_report(rows.withColumn("pred_label", t.net_label(F.col("net_score"), F.col("threshold"))), ["threshold"])


def signal_coverage(pred: DataFrame) -> DataFrame:
    """(n, with_signal, coverage, neutral_inflation): rows with any score, and predicted less true neutrals."""
    some = (F.col("growth") != 0) | (F.col("risk") != 0) | (F.col("cost_pressure") != 0)
    n = F.count(F.lit(1))
    return pred.agg(
        n.alias("n"), F.count_if(some).alias("with_signal"), F.round(F.coalesce(F.try_divide(F.count_if(some), n), F.lit(0.0)), 4).alias("coverage"),
        (F.count_if(F.col("pred_label") == "neutral") - F.count_if(F.col("true_label") == "neutral")).alias("neutral_inflation"),
    )


def method_coverage(pred: DataFrame, by: list[str] | None = None, misses: list[str] = d.MISS_METHODS) -> DataFrame:
    """(by, n, coverage, breakdown): share of methods that aren't a miss, and the count of each."""
    by = by or []
    per = pred.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.round(F.sum(F.when(~F.col("method").isin(misses), F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("coverage"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("method", "n")))).alias("breakdown"),
    )


def error_sample(pred: DataFrame, n: int = 30, order: str = "id") -> DataFrame:
    """The first ``n`` wrong rows in item order (the size of the report, kept by a top-n in every task)."""
    return pred.where("true_label <> pred_label").orderBy(order).limit(n)


def stratified_split(items: DataFrame, shares: tuple[float, float, float] = (0.70, 0.15, 0.15), seed: str = "42", label: str = "true_label", key: str = "id") -> DataFrame:
    """``split`` train, val or test with the same proportions in every label: rows of a label in the order of a seeded hash, cut by rank.
    Ranks are exact over ranges of the hash, so no task holds a whole label."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    h = F.md5(F.concat(text, F.lit(f"|{seed}")))
    ahead = unit_hash(text, F.lit(seed))  # the same digest's first digits
    rank, rows = free_name(items, "_rank"), free_name(items, "_rows")
    df = ranked(items, [F.col(label)], ahead, [h, F.col(key)], rank, rows=rows, buckets=buckets_for(items))
    n, place = F.col(rows), F.col(rank) + 1
    a, b = F.floor(n * shares[0] + 0.5), F.floor(n * (shares[0] + shares[1]) + 0.5)
    return df.select(*items.columns, F.when(place <= a, "train").when(place <= b, "val").otherwise("test").alias("split"))


def class_distribution(items: DataFrame, by: str = "split", label: str = "true_label", labels: list[str] = d.LABELS) -> DataFrame:
    return items.groupBy(by).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])


def tune_c(train: DataFrame, val: DataFrame, grid: list[float] = d.C_GRID, label: str = "true_label", names: list[str] = d.LABELS) -> tuple[float, DataFrame]:
    """(best C, (C, macro_f1) of each): the first best by macro F1 on ``val``. Rows are (vector, label_id, label). All penalties are fitted in the
    same passes over ``train`` and judged in one over ``val``."""
    train = train.persist()
    try:
        weights = logistic.fit_penalties(train, grid, len(names))
    finally:
        train.unpersist()
    said = logistic.predictions(weights)(F.col("vector").cast("array<double>"))
    each = val.where("vector IS NOT NULL").select(F.col(label).alias("true_label"), F.posexplode(said).alias("k", "y"))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)
    judged = each.select("true_label", pick([float(c) for c in grid], F.col("k")).alias("penalty"), pick(names, F.col("y")).alias("pred_label"))
    found = {r.penalty: r.f1 for r in classification_report(judged, ["penalty"], names).where("label = 'macro'").collect()}
    results = [(float(c), float(found.get(float(c), 0.0))) for c in grid]
    return max(results, key=lambda r: r[1])[0], train.sparkSession.createDataFrame(results, "c double, macro_f1 double")


def tune_threshold(pred: DataFrame, grid: list[float] = d.CONFIDENCE_GRID, last_tier: bool = False) -> DataFrame:
    """(threshold, label, f1, ...): the report if rows under each confidence are left to the last tier (as neutral until it
    answers); without one the threshold changes nothing."""
    rows = pred.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in grid])))
    low = (F.col("confidence") < F.col("threshold")) & F.lit(last_tier)
    return classification_report(rows.withColumn("pred_label", F.when(low, "neutral").otherwise(F.col("pred_label"))), ["threshold"])


def engine_comparison(predictions: DataFrame) -> DataFrame:
    """(engine, accuracy, macro_f1, weighted_f1, coverage) over predictions with ``engine`` and ``method``."""
    rep = classification_report(predictions, ["engine"]).groupBy("engine").agg(
        *[F.max(F.when(F.col("label") == x, F.col("f1"))).alias(n) for x, n in (("accuracy", "accuracy"), ("macro", "macro_f1"), ("weighted", "weighted_f1"))]
    )
    return rep.join(method_coverage(predictions, ["engine"]).select("engine", "coverage"), "engine")


def miss_method(engine: str, parsed: Column, hit: Column) -> Column:
    """How each engine names an item: the first counts one as hit if growth or risk isn't 0 and unparsed ones as miss; the second
    if any hit list isn't empty, and unparsed ones as lexicon."""
    v1 = F.when((F.col("growth") != 0) | (F.col("risk") != 0), "lexicon").otherwise("lexicon_miss")
    if engine == "v1":
        return F.when(parsed, v1).otherwise("lexicon_miss")
    return F.when(~parsed | hit, "lexicon").otherwise("lexicon_miss")
