"""Quality classifier: a sparse rule ensemble over text statistics, compiled into column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import free_name

#: The most labelled rows that are used to fit (chosen by hash; all rows are scored).
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.3
Rule = tuple[tuple[int, bool, float], ...]

#: name -> expression over T_ (the text, null as empty), W_ (its words) and N_ (its length, 1 at least).
STATISTICS: dict[str, str] = {
    "log_chars": "log1p(length(T_))",
    "log_words": "log1p(size(W_))",
    "chars_a_word": "N_ / greatest(size(W_), 1)",
    "distinct_words": "size(array_distinct(W_)) / greatest(size(W_), 1)",
    "upper": "(length(T_) - length(regexp_replace(T_, '\\\\p{Lu}+', ''))) / N_",
    "digits": "(length(T_) - length(regexp_replace(T_, '[0-9]+', ''))) / N_",
    "marks": "(length(T_) - length(translate(T_, '#$%&*@^~_=<>{}[]+', ''))) / N_",
    "exclamations": "(length(T_) - length(translate(T_, '!', ''))) / N_",
    "bars": "(length(T_) - length(translate(T_, '|', ''))) / N_",
    "stops": "(length(T_) - length(translate(T_, '.?', ''))) / greatest(size(W_), 1)",
    "commas": "(length(T_) - length(translate(T_, ',', ''))) / greatest(size(W_), 1)",
    "distinct_lines": "size(array_distinct(split(T_, '\\n', -1))) / size(split(T_, '\\n', -1))",
    "chars_a_line": "log1p(N_ / size(split(T_, '\\n', -1)))",
}


def statistics(df: DataFrame, text: str = "text", out: str = "_q") -> DataFrame:
    """``df`` with one array column ``out`` of the statistics of each whole text; null counts as empty."""
    t = free_name(df, f"{out}_t")
    w = free_name(df, f"{out}_w")
    df = df.withColumn(t, F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn(w, F.expr(f"filter(split({t}, '[ \\\\t\\\\r\\\\n]+'), x -> x <> '')"))
    exprs = [e.replace("T_", t).replace("W_", w).replace("N_", f"greatest(length({t}), 1)") for e in STATISTICS.values()]
    return df.withColumn(out, F.array(*[F.expr(e).cast("double") for e in exprs])).drop(t, w)


@dataclass
class RuleEnsemble:
    """Weights of conjunctive rules over the statistics; ``intercept`` alone if nothing could be learned."""

    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def score(self, stats: Column) -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule_column(rule, stats), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[tuple[float, str]]:
        names = list(STATISTICS)
        text = lambda r: " AND ".join(f"{names[i]} {'>' if up else '<='} {v:.6g}" for i, up, v in r)
        return sorted(((w, text(r)) for r, w in zip(self.rules, self.weights, strict=True)), key=lambda x: -abs(x[0]))


def rule_column(rule: Rule, stats: Column) -> Column:
    return reduce(lambda a, b: a & b, [stats[i] > F.lit(v) if up else stats[i] <= F.lit(v) for i, up, v in rule])


def tree_rules(debug: str) -> list[Rule]:
    """Every path from the root of a printed decision tree to any node below it, as a conjunction."""
    rules: list[Rule] = []
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if m:
            depth = len(m[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(m[2]), m[3] == ">", float(m[4])))]
            rules.append(simplify(tuple(c for _, c in path)))
    return rules


def simplify(rule: Rule) -> Rule:
    """The tightest bound of each statistic and side, in order."""
    best: dict[tuple[int, bool], float] = {}
    for i, up, v in rule:
        best[i, up] = v if (i, up) not in best else max(best[i, up], v) if up else min(best[i, up], v)
    return tuple((i, up, v) for (i, up), v in sorted(best.items()))


def fit(
    labelled: DataFrame, label: str = "quality", stats: str = "_q", trees: int = 20, depth: int = 3, lasso: float = 0.002,
    max_rows: int = MAX_TRAIN_ROWS, seed: int = 7, key: str = "doc_id",
) -> RuleEnsemble:
    """Fit on rows with ``stats`` and a 0/1 ``label``; null labels take no part. At most about ``max_rows`` rows, by hash of
    ``key``. One class or no rows give a constant score: the smoothed share of label 1 (no rows: 1/2)."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("label"), stats, key)
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    # dealt by id and sorted, so that the same rows give the same model wherever they were read
    rows = rows.repartition(8, key).sortWithinPartitions(key, stats).select("label", stats).persist()
    try:
        seen = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        good, all_ = seen.get(1.0, 0), sum(seen.values())
        if len(seen) < 2:
            share = (good + 1) / (all_ + 2)
            return RuleEnsemble(_logit(share))
        forest = RandomForestClassifier(
            numTrees=trees, maxDepth=depth, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=seed, maxBins=64,
            featuresCol="x", labelCol="label",
        ).fit(rows.select("label", array_to_vector(stats).alias("x")))
        rules = sorted({r for t in forest.trees for r in tree_rules(t.toDebugString)})
        if not rules:
            return RuleEnsemble(_logit(good / all_))
        hits = F.array(*[F.when(rule_column(r, F.col(stats)), 1.0).otherwise(0.0) for r in rules])
        table = rows.select("label", array_to_vector(hits).alias("x")).persist()
        try:
            model = LogisticRegression(
                elasticNetParam=1.0, regParam=lasso, maxIter=50, featuresCol="x", labelCol="label"
            ).fit(table)
        finally:
            table.unpersist()
        kept = [(r, w) for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-6]
        return RuleEnsemble(float(model.intercept), [r for r, _ in kept], [w for _, w in kept])
    finally:
        rows.unpersist()


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def held_out(key: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(5)) == 0, F.lit(False))


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text", label: str = "quality",
    **how,
) -> DataFrame:
    """``docs`` plus ``held_out``, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from ``threshold`` on).

    Only statistics of the whole text are inputs. Labels outside the held-out fold teach; of several labels of one id
    the smallest counts. Null and empty texts have the statistics of an empty text; a null id is not held out and
    teaches nothing; repeated rows score alike; columns that have the name of a new one are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_label"))
    taught = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where(~held_out("_id"))
    taught = statistics(taught.join(marks, "_id"), "_text").select("_id", "_label", "_q")
    model = fit(taught, "_label", "_q", key="_id", **how)
    q = free_name(docs, "_q")
    out = statistics(docs, text, q).withColumn("held_out", held_out(key)).withColumn("score", model.score(F.col(q))).drop(q)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
