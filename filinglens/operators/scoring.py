"""Sentence scoring (rows E1-E14): column expressions over a table of sentences, or over a document's array of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import text as t
from ..functions.models import phrase_column
from .sentences import Features

HIT_LISTS = ["growth_lm", "growth_phrases", "risk_lm", "risk_phrases", "uncertainty_lm", "cost_phrases"]

#: From here on one pass of an automaton costs less than a look for each phrase.
MANY_PHRASES = 60


@dataclass(frozen=True)
class Scorer:
    """Everything a score depends on."""

    growth: list[str] = field(default_factory=list)
    risk: list[str] = field(default_factory=list)
    uncertainty: list[str] = field(default_factory=list)
    growth_phrases: list[str] = field(default_factory=lambda: list(d.GROWTH_PHRASES))
    risk_phrases: list[str] = field(default_factory=lambda: list(d.RISK_PHRASES))
    cost_phrases: list[str] = field(default_factory=lambda: list(d.COST_PHRASES))
    section_weights: dict[str, float] | None = None
    section_prefixes: dict[str, float] | None = None
    negations: list[str] = field(default_factory=lambda: list(d.NEGATIONS))
    scope_negations: list[str] = field(default_factory=lambda: list(d.SCOPE_NEGATIONS))
    window: int = 5
    min_tokens: int | None = None


def without_blocked(words: list[str], blocked: list[str] = d.GROWTH_BLOCKED_V2) -> list[str]:
    """An unblocked growth lexicon without the second version's block list, which is smaller than the first's."""
    gone = set(blocked)
    return [w for w in words if w not in gone]


def hits_by_join(sentences: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, growth_lm, risk_lm, uncertainty_lm) for lexicons too long for a literal: terms are exploded and joined."""
    lem = sentences.select(*keys, F.explode("terms").alias("word")).join(lexicon, "word")
    lists = [F.sort_array(F.collect_set(F.when(F.col("category") == c, F.col("word")))).alias(f"{c}_lm") for c in ("growth", "risk", "uncertainty")]
    return lem.groupBy(*keys).agg(*lists)


#: Gives a sentence's value by its name: a column of a table of sentences, or a field of an array's element.
Get = Callable[[str], Column]
SCORES = ["growth", "risk", "cost_pressure"]


def _hits(get: Get, s: Scorer, found: Column | None = None) -> Column:
    """struct of the six hit lists, out of ``terms`` and ``low`` (the lower-cased text); ``found`` are the phrases of all three lists that
    it contains, where they are known."""
    term = get("terms")
    phrases = lambda low, own: t.phrase_hits(low, own) if found is None else F.sort_array(t.only(found, own))
    return t.let(get("low"), lambda low: F.struct(
        t.lexicon_hits(term, s.growth).alias("growth_lm"), phrases(low, s.growth_phrases).alias("growth_phrases"),
        t.lexicon_hits(term, s.risk).alias("risk_lm"), phrases(low, s.risk_phrases).alias("risk_phrases"),
        t.lexicon_hits(term, s.uncertainty).alias("uncertainty_lm"), phrases(low, s.cost_phrases).alias("cost_phrases"),
    ))


def hit_columns(df: DataFrame, s: Scorer) -> DataFrame:
    """The six hit lists of every sentence. Over ``MANY_PHRASES`` phrases are found by an automaton that reads a sentence once."""
    phrases = [*s.growth_phrases, *s.risk_phrases, *s.cost_phrases]
    get = lambda c: F.lower("text") if c == "low" else F.col(c)
    if len(phrases) <= MANY_PHRASES:
        return df.select("*", F.inline(F.array(_hits(get, s))))
    out = df.withColumn("_found", phrase_column(phrases)(F.lower("text")))
    return out.select("*", F.inline(F.array(_hits(get, s, F.col("_found"))))).drop("_found")


def _some(get: Get, *cols: str) -> Column:
    return sum((F.size(get(c)) for c in cols[1:]), F.size(get(cols[0]))) > 0


def _raw(get: Get) -> dict[str, Column]:
    n = lambda c: F.size(get(c)).cast("double")
    return {
        "growth": n("growth_lm") + n("growth_phrases") * d.PHRASE_WEIGHT,
        "risk": n("risk_lm") + n("uncertainty_lm") * d.UNCERTAINTY_WEIGHT + n("risk_phrases") * d.PHRASE_WEIGHT,
        "cost_pressure": n("cost_phrases") * d.PHRASE_WEIGHT,
    }


def _flip(get: Get) -> dict[str, Column]:
    return {c: F.when(get("has_negation"), -get(c)).otherwise(get(c)) for c in SCORES}


def _zero(get: Get, when: Column | None = None) -> dict[str, Column]:
    neg = get("has_negation") if when is None else when
    return {
        "growth": F.when(neg & _some(get, "growth_lm", "growth_phrases"), 0.0).otherwise(get("growth")),
        "risk": F.when(neg & _some(get, "risk_lm", "risk_phrases"), 0.0).otherwise(get("risk")),
        "cost_pressure": F.when(neg, 0.0).otherwise(get("cost_pressure")),
    }


def _scope(get: Get, s: Scorer) -> dict[str, Column]:
    negations = list(dict.fromkeys([*s.negations, *s.scope_negations]))
    opened = t.some_of(get("words"), negations) | t.some_of(get("lemma"), negations)
    scoped = get("has_negation") & opened
    near = lambda c: t.near_negation(get("words"), get("lemma"), get(c), s.window, negations)
    out = _zero(get, get("has_negation") & ~opened)
    return {
        "growth": F.when(scoped & (F.size(get("growth_lm")) > 0) & near("growth_lm"), 0.0).otherwise(out["growth"]),
        "risk": F.when(scoped & (F.size(get("risk_lm")) > 0) & near("risk_lm"), 0.0).otherwise(out["risk"]),
        "cost_pressure": F.when(scoped, 0.0).otherwise(out["cost_pressure"]),
    }


def _damp(get: Get, factor: float = d.HEDGE_FACTOR) -> dict[str, Column]:
    return {c: F.when(get("has_hedge"), get(c) * factor).otherwise(get(c)) for c in SCORES}


def _weigh(get: Get, s: Scorer) -> dict[str, Column]:
    w = t.section_weight(get("section"), s.section_weights, s.section_prefixes)
    return {c: get(c) * w for c in SCORES}


def raw_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(_raw(F.col))


def negate_flip(df: DataFrame) -> DataFrame:
    """Version 1: a negated sentence changes the sign of all three."""
    return df.withColumns(_flip(F.col))


def negate_zero(df: DataFrame, when: Column | None = None) -> DataFrame:
    """Version 2: what its hits made is cancelled; risk of uncertainty words alone survives; cost always goes."""
    return df.withColumns(_zero(F.col, when))


def negate_scope(df: DataFrame, s: Scorer) -> DataFrame:
    """Version 3: growth or risk is cancelled only if a negation is within the window of a lexicon hit of it; cost
    always; a flagged sentence without negation token falls back to version 2."""
    return df.withColumns(_scope(F.col, s))


def hedge_damp(df: DataFrame, factor: float = d.HEDGE_FACTOR) -> DataFrame:
    return df.withColumns(_damp(F.col, factor))


def weigh_sections(df: DataFrame, s: Scorer) -> DataFrame:
    return df.withColumns(_weigh(F.col, s))


def has_hit(get: Get = F.col) -> Column:
    return _some(get, *HIT_LISTS)


def score_sentences(df: DataFrame, scorer: Scorer, version: str = "v1", engine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Scores of sentences by engine version; the output columns are the same for all. ``engine`` replaces the three built-in ones.
    Version 3 without words that open a negation's scope can't be built: version 2 scores then, and engine_version says so."""
    if engine is not None:
        return engine(df)
    version = built_version(scorer, version)
    scorer, least = _of_version(scorer, version)
    return _finished(raw_scores(hit_columns(df.where(F.size("words") >= least), scorer)), scorer, version)


def built_version(scorer: Scorer, version: str) -> str:
    return "v2" if version == "v3" and not scorer.scope_negations else version


def _of_version(scorer: Scorer, version: str) -> tuple[Scorer, int]:
    if version not in d.MIN_TOKENS:
        raise ValueError(f"unknown engine version {version!r}")
    if version != "v1" and scorer.growth_phrases == d.GROWTH_PHRASES:
        scorer = replace(scorer, growth_phrases=d.GROWTH_PHRASES_V2)
    return scorer, d.MIN_TOKENS[version] if scorer.min_tokens is None else scorer.min_tokens


def _steps(scorer: Scorer, version: str) -> list[Callable[[Get], dict[str, Column]]]:
    """What makes scores out of raw ones, in order."""
    negated = {"v1": _flip, "v2": _zero, "v3": lambda get: _scope(get, scorer)}[version]
    return [negated, _damp, lambda get: _weigh(get, scorer)]


def _finished(raw: DataFrame, scorer: Scorer, version: str) -> DataFrame:
    for step in _steps(scorer, version):
        raw = raw.withColumns(step(F.col))
    return raw.withColumn("net_score", F.col("growth") - F.col("risk")).withColumn("engine_version", F.lit(version))


def scored_array(sentences: Column, scorer: Scorer, features: Features | None = None, version: str = "v1") -> Column:
    """A document's sentences (``sentence_array``) scored inside the row: array<struct<sent_id, section, text, n_tokens, the six hit lists, growth,
    risk, cost_pressure, net_score>>, the same values as ``score_sentences`` gives row by row. Words are dropped on the way."""
    features, version = features or Features(), built_version(scorer, version)
    scorer, least = _of_version(scorer, version)
    low = F.transform(sentences, lambda x: t.let(F.lower(x["text"]), lambda y: F.struct(x.alias("s"), y.alias("low"), features.words_of(y).alias("w"))))
    enough = F.filter(low, lambda x: F.size(x["w"]) >= least)
    # a sentence's words are looked up once in all lists together, and what is found there in each one
    listed = list(dict.fromkeys([*scorer.growth, *scorer.risk, *scorer.uncertainty]))
    hit = F.transform(enough, lambda x: t.let(features.flags_of(x["w"], listed), lambda f: F.struct(
        x["s"].alias("s"), f.alias("f"), _hits(lambda c: x["low"] if c == "low" else f[c], scorer).alias("h")
    )))

    def scored(x: Column) -> Column:
        own = {c: x["s"][c] for c in ("sent_id", "section", "text")} | {c: x["h"][c] for c in HIT_LISTS}
        get = lambda c, known=own: known[c] if c in known else x["f"][c]
        for step in [_raw, *_steps(scorer, version)]:
            own = own | step(get)
            get = lambda c, known=own: known[c] if c in known else x["f"][c]
        kept = [own[c].alias(c) for c in ("sent_id", "section", "text")]
        return t.let(F.struct(*[own[c].alias(c) for c in SCORES]), lambda v: F.struct(
            *kept, F.size(x["f"]["words"]).alias("n_tokens"), *[own[c].alias(c) for c in HIT_LISTS], *[v[c].alias(c) for c in SCORES],
            (v["growth"] - v["risk"]).alias("net_score"),
        ))

    return F.transform(hit, scored)


def scored_rows(sentences: DataFrame, scorer: Scorer, features: Features | None = None, version: str = "v1") -> DataFrame:
    """Rows of ``sentences`` (..., section, text) scored: their columns, n_tokens, the six hit lists, growth, risk, cost_pressure and net_score, the
    same values as ``scored_array`` makes inside a document's row.

    For work that goes on with rows. Lambdas are evaluated node by node; here short lists meet array functions without one, so Spark generates code
    for the whole way from a sentence to its scores. What several steps use is held in an unfolded array of one.
    """
    features, version = features or Features(), built_version(scorer, version)
    scorer, least = _of_version(scorer, version)
    hold = lambda value, name: F.explode(F.array(value)).alias(name)
    words = sentences.select("*", hold(F.lower("text"), "_low"))
    words = words.select("*", hold(features.words_of(F.col("_low")), "_w")).where(F.size("_w") >= least)
    sought = list(dict.fromkeys([*scorer.growth, *scorer.risk, *scorer.uncertainty, *features.negation, *features.hedges]))
    if features.lemma is None:
        seen = words.select("*", hold(t.only(F.col("_w"), sought), "_seen")).withColumn("lemma", F.col("_w"))
        lemma = None
    else:
        seen = words.withColumn("_seen", F.col("_w")).withColumn("lemma", features.lemma(F.col("_w")))
        lemma = F.col("lemma")
    found, phrases = F.col("_seen"), [*scorer.growth_phrases, *scorer.risk_phrases, *scorer.cost_phrases]
    if len(phrases) > MANY_PHRASES:
        seen = seen.withColumn("_found", phrase_column(phrases)("_low"))
        of = lambda own: F.sort_array(t.only(F.col("_found"), own))
    else:
        of = lambda own: (t.phrase_hits_plain if len(own) <= t.SHORT else t.phrase_hits)(F.col("_low"), own)
    seen = seen.select("*", hold(t.terms(found, lemma, features.stop), "terms"))
    raw = raw_scores(seen.select(
        *sentences.columns, F.size("_w").alias("n_tokens"), F.col("_w").alias("words"), "lemma",
        t.has_negation(found, features.negation).alias("has_negation"), t.has_hedge(found, lemma, features.hedges).alias("has_hedge"),
        *[t.lexicon_hits(F.col("terms"), getattr(scorer, c)).alias(f"{c}_lm") for c in ("growth", "risk", "uncertainty")],
        *[of(getattr(scorer, f"{c}_phrases")).alias(f"{c}_phrases") for c in ("growth", "risk", "cost")],
    ))
    return _finished(raw, scorer, version).select(*sentences.columns, "n_tokens", *HIT_LISTS, *SCORES, "net_score")


def hit_rows(sentences: DataFrame, scorer: Scorer, features: Features | None = None, version: str = "v1") -> DataFrame:
    """The rows that ``scored_rows`` keeps, with their own columns and ``any_hit``, which is ``has_hit`` there.

    For counts. No list of hits is made: a sentence's first tokens tell whether it has enough of them (``features.pattern`` matches no empty text),
    and it is cut into all of them only if it contains a listed word anywhere. Dictionaries and long lists take the way of ``scored_rows``.
    """
    features, version = features or Features(), built_version(scorer, version)
    own, least = _of_version(scorer, version)
    phrases = list(dict.fromkeys([*own.growth_phrases, *own.risk_phrases, *own.cost_phrases]))
    listed = [w for w in dict.fromkeys([*own.growth, *own.risk, *own.uncertainty]) if w not in set(features.stop)]
    if features.lemma is not None or max(len(phrases), len(listed)) > t.SHORT:
        return scored_rows(sentences, scorer, features, version).select(*sentences.columns, has_hit().alias("any_hit"))
    low = F.col("_low")
    within = lambda values: reduce(Column.__or__, [F.contains(low, F.lit(v)) for v in values], F.lit(False))
    rows = sentences.select("*", F.explode(F.array(F.lower("text"))).alias("_low"))
    # an atomic group gives nothing back, so each takes one token, from the left
    rows = rows.where(F.rlike(low, F.lit(rf"\A(?>(?s:.*?)(?:{features.pattern})){{{least}}}")))
    words = F.when(within(listed), t.some_of(features.words_of(low), listed)).otherwise(F.lit(False))
    return rows.select(*sentences.columns, (within(phrases) | words).alias("any_hit"))


def score_versions(df: DataFrame, scorer: Scorer, versions: list[str]) -> DataFrame:
    """The rows of ``score_sentences`` for several versions, out of one pass: sentences are tokenised and their hits found once, the
    versions' scores are columns of one row, and those are unfolded last."""
    versions = list(dict.fromkeys(built_version(scorer, v) for v in versions))
    settings = {v: _of_version(scorer, v) for v in versions}
    if len({tuple(s.growth_phrases) for s, _ in settings.values()}) > 1:  # other phrases make other hits
        return reduce(DataFrame.unionByName, [score_sentences(df, scorer, v) for v in versions])
    shared = next(iter(settings.values()))[0]
    out = raw_scores(hit_columns(df.where(F.size("words") >= min(k for _, k in settings.values())), shared))
    names = [*SCORES, "net_score", "engine_version"]
    out = out.withColumn("_raw", F.struct(*SCORES))
    for v, (s, least) in settings.items():
        out = _finished(out, s, v).withColumn(f"_{v}", F.when(F.size("words") >= least, F.struct(*names)))
        out = out.drop(*names[3:]).withColumns({c: F.col(f"_raw.{c}") for c in SCORES})
    each = F.explode(F.array_compact(F.array(*[f"_{v}" for v in versions]))).alias("_s")
    rest = [c for c in out.columns if c not in (*names, "_raw", *(f"_{v}" for v in versions))]
    return out.select(*rest, each).select(*rest, "_s.*")


def simple_score(df: DataFrame, scorer: Scorer, key: str = "doc_id", least: int = 6) -> DataFrame:
    """(key, growth, risk): sums of sign times weight times hits; a negated sentence counts negative, a hedged one half."""
    hit = hit_columns(df.where(F.size("words") >= least), scorer)
    weight = F.when(F.col("has_negation"), -1.0).otherwise(1.0) * F.when(F.col("has_hedge"), d.HEDGE_FACTOR).otherwise(1.0)
    return hit.groupBy(key).agg(F.sum(weight * F.size("growth_lm")).alias("growth"), F.sum(weight * F.size("risk_lm")).alias("risk"))
