"""Mixing sources to target weights by temperature (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import buckets_for, materialise, ranked, unit_hash, words_sql

SEED = "mix-1"
#: Production targets: this share of the largest possible entropy, but no source more often than this.
ENTROPY_SHARE = 0.9
MAX_REPEATS = 4.0
STEPS = 40
ALPHA_DIGITS = 6


def source_tokens(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, tokens, n_docs); tokens are runs of characters other than space, tab and line ends."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(words_sql(F.col(text))).alias("tokens"), F.count(F.lit(1)).alias("n_docs"))


def exponent(sources: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> float:
    """The exponent in [0, 1] nearest to 1 whose weights (share ** exponent, normalised) reach the entropy, unless some
    source would then repeat more than ``max_repeats`` times as often as the least repeated one: then the
    least exponent within that limit. Each bisection step is one aggregate of the source table; only its totals
    come to the driver.
    """
    s = sources.where("tokens > 0")
    total = s.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("hi"), F.min("tokens").alias("lo")).first()
    if not total.n or total.n == 1:
        return 1.0
    logs = s.select(F.log(F.col("tokens") / F.lit(float(total.t))).alias("x"))
    goal = entropy_share * math.log(total.n)

    def entropy(alpha: float) -> float:
        e = F.exp(F.col("x") * alpha)
        z, zx = logs.agg(F.sum(e).alias("z"), F.sum(e * F.col("x") * alpha).alias("zx")).first()
        return math.log(z) - zx / z

    def bisect(meets) -> float:
        """Greatest exponent that meets a test which holds at 0 and, once lost, stays lost."""
        if meets(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            mid = (low + high) / 2
            low, high = (mid, high) if meets(mid) else (low, mid)
            if high - low < 10.0 ** -(ALPHA_DIGITS + 2):
                break
        return low

    by_entropy = bisect(lambda a: entropy(a) >= goal)
    # repeats are proportional to share ** (exponent - 1), so the extreme sources decide
    spread = math.log(total.hi / total.lo)
    by_repeats = 0.0 if spread == 0 or max_repeats <= 0 else max(0.0, 1.0 - math.log(max(max_repeats, 1.0)) / spread)
    return round(min(1.0, max(by_entropy, by_repeats)), ALPHA_DIGITS)


def weights(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """(source, tokens, n_docs, weight, target): ``target`` is the whole number of tokens each source gives.

    Without ``budget`` it is the least one that takes every source whole at least once, so nothing is dropped.
    Sources without tokens have weight 0 and are taken whole once.
    """
    s = sources.where("tokens > 0")
    t = float(s.agg(F.sum("tokens").alias("t")).first().t or 1)
    raw = F.exp(F.log(F.col("tokens") / F.lit(t)) * alpha)
    agg = s.agg(F.sum(raw).alias("z"), F.max(F.col("tokens") / raw).alias("most")).first()
    z, most = float(agg.z or 1.0), float(agg.most or 0.0)
    total = z * most if budget is None else float(budget)
    weight = F.when(F.col("tokens") > 0, raw / F.lit(z)).otherwise(0.0)
    out = sources.withColumn("weight", weight)
    # a hair is added so that a source due exactly once isn't cut by rounding
    return out.withColumn("target", F.floor(F.col("weight") * F.lit(total) + 1e-3).cast("long"))


def mix(
    docs: DataFrame, budget: int | None = None, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS,
    source: str = "source", key: str = "doc_id", text: str = "text", seed: str = SEED, buckets: int | None = None,
) -> DataFrame:
    """Rows of ``docs`` plus ``epoch`` (from 0): a source due e times is given as floor(e) whole permutations and the beginning
    of one more, up to its token budget.

    In a permutation the rows of a source stand in the order of a seeded hash of their key; of the last, begun one the
    rows count whose tokens before are under what is left of the budget. Every row of a hot source lies in
    one of ``buckets`` windows, never in one task.

    Defined cases: null text has no tokens (taken with its source); a null source is a source; ties and repeated rows fall to
    key, then text; sources without tokens are taken once; no rows give no rows; a column ``epoch`` is replaced.
    """
    docs = docs.drop("epoch")
    buckets = buckets or buckets_for(docs)
    sources = materialise(source_tokens(docs, source, text))
    alpha = exponent(sources, entropy_share, max_repeats)
    plan = weights(sources, alpha, budget).select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("s"),
        F.col("tokens").alias("all"), F.col("target").alias("target"),
    )
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("s"),
        words_sql(F.col(text)).cast("long").alias("n"),
        unit_hash(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("u"),
    )
    order = [F.col("u"), F.col(f"row.{key}"), F.col(f"row.{text}")]
    df = ranked(df, [F.col("s")], F.col("u"), order, "rank", size=F.col("n"), running="before", buckets=buckets)
    df = df.join(plan, "s")
    whole = F.when(F.col("all") > 0, F.expr("target div all")).otherwise(1)
    left = F.when(F.col("all") > 0, F.expr("target % all")).otherwise(0)
    times = (whole + F.when(F.col("before") < left, 1).otherwise(0)).cast("int")
    df = df.withColumn("times", times).where("times > 0")
    return df.select("row.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"))
