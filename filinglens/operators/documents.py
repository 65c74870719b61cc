"""Document aggregates and report tables (rows F1-F13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import exact_mean, let, millionths, ratio_of_millionths, run_starts
from .scoring import HIT_LISTS, SCORES, Get, has_hit

#: Where a tallied term comes from: dimension, source, hit list.
TALLIED = [("growth", "phrase", "growth_phrases"), ("growth", "LM", "growth_lm"), ("risk", "phrase", "risk_phrases"), ("risk", "LM", "risk_lm"), ("cost_pressure", "phrase", "cost_phrases")]
#: Right-closed bins of the net histogram.
BINS = [-10.0, -4.0, -2.0, 0.0, 2.0, 4.0, 10.0]
BIN_NAMES = ["<= -4", "-4 to -2", "-2 to 0", "0 to 2", "2 to 4", ">= 4"]


def document_scores(scored: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Means over all scored sentences, rounded to 3; net from the unrounded ones; 0 without scored sentence. One shuffle with map-side sums."""
    net = exact_mean(F.col("growth") - F.col("risk"), 3).alias("net_operating_signal")
    means = scored.groupBy(key).agg(*[exact_mean(c, 3).alias(c) for c in SCORES], net)
    cols = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in (*SCORES, "net_operating_signal")]
    return documents.join(means, key, "left").select(*documents.columns, *cols)


def coverage(scored: DataFrame, key: str = "doc_id", hit: Column | None = None) -> DataFrame:
    """(key, scored, scored_with_hits); ``hit`` tells whether a row has one, where its hit lists weren't made."""
    return scored.groupBy(key).agg(F.count(F.lit(1)).alias("scored"), F.count_if(has_hit() if hit is None else hit).alias("scored_with_hits"))


def sentences_by_section(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, n, ord): counts, most frequent first."""
    n = sentences.groupBy(key, "section").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("ord", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "section")))


def _strength(get: Get) -> Column:
    """|net| + |cost| in whole millionths: sums of the same scores in another order are equal."""
    return millionths(F.abs(get("net_score")) + F.abs(get("cost_pressure")))


def top_sentences(scored: DataFrame, n: int = 20, key: str = "doc_id") -> DataFrame:
    """The ``n`` of largest |net| + |cost|, in whole millionths, of each document, ties in sentence order."""
    w = W.partitionBy(key).orderBy(F.desc(_strength(F.col)), "sent_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tally_terms(scored: DataFrame, n: int = 25, key: str = "doc_id") -> DataFrame:
    """(key, dimension, term, source, count, rank): once a sentence and source; the source is that of the last hit."""
    def as_hits(dim: str, src: str, c: str) -> Column:
        late = F.lit(1 if src == "LM" else 0).alias("late")
        return F.transform(c, lambda x: F.struct(F.lit(dim).alias("dimension"), F.lit(src).alias("source"), late, x.alias("term")))

    hits = F.flatten(F.array(*[as_hits(*x) for x in TALLIED]))
    rows = scored.select(key, "sent_id", F.inline(hits))
    counts = rows.groupBy(key, "dimension", "term").agg(
        F.max_by("source", F.struct("sent_id", "late")).alias("source"), F.count(F.lit(1)).alias("count")
    )
    w = W.partitionBy(key, "dimension").orderBy(F.desc("count"), "term")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def scores_of(scored: Column) -> Column:
    """struct<growth, risk, cost_pressure, net_operating_signal> of a document out of its scored sentences (``scoring.scored_array``): what
    ``document_scores`` gives, inside the row."""
    names = [*SCORES, "net_score"]
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in names])
    totals = F.aggregate(scored, zero, lambda a, x: F.struct(*[(a[c] + millionths(x[c])).alias(c) for c in names]))
    n = F.size(scored).cast("long")
    return let(totals, lambda a: F.struct(*[ratio_of_millionths(a[c], n, 3).alias("net_operating_signal" if c == "net_score" else c) for c in names]))


def coverage_of(scored: Column) -> Column:
    """struct<scored, scored_with_hits>."""
    hits = F.aggregate(scored, F.lit(0).cast("long"), lambda a, x: a + has_hit(lambda c: x[c]).cast("long"))
    return F.struct(F.size(scored).cast("long").alias("scored"), hits.alias("scored_with_hits"))


def top_of(scored: Column, n: int = 20) -> Column:
    """array<struct<rank, sent_id, section, text, hit lists, scores, net_score>>: the rows of ``top_sentences``, inside the row. Only the
    sentences' keys are sorted."""
    keys = F.transform(scored, lambda x, i: F.struct((-_strength(lambda c: x[c])).alias("k"), x["sent_id"].alias("sent_id"), i.alias("i")))
    cols = ["sent_id", "section", "text", *HIT_LISTS, *SCORES, "net_score"]
    first = F.slice(F.sort_array(keys), 1, n)
    return F.transform(first, lambda k, r: let(F.get(scored, k["i"]), lambda x: F.struct((r + 1).cast("int").alias("rank"), *[x[c].alias(c) for c in cols])))


def tally_of(scored: Column, n: int = 25) -> Column:
    """array<struct<dimension, term, source, count, rank>>: the rows of ``tally_terms``, inside the row. All hits are sorted once, and
    a term's are then neighbours."""
    def hits(x: Column) -> Column:
        one = lambda dim, src, c: F.transform(x[c], lambda term: F.struct(
            F.lit(dim).alias("dimension"), term.alias("term"), x["sent_id"].alias("sent_id"), F.lit(int(src == "LM")).alias("late"), F.lit(src).alias("source")
        ))
        return F.concat(*[one(*t) for t in TALLIED])

    def counted(h: Column) -> Column:
        before = lambda i: F.get(h, i - 1)
        starts = run_starts(h, lambda a, x: (a["dimension"] == x["dimension"]) & (a["term"] == x["term"]))
        return let(starts, lambda at: F.transform(at, lambda i, j: let(F.coalesce(F.get(at, j + 1), F.size(h)), lambda end: F.struct(
            F.get(h, i)["dimension"].alias("dimension"), (i - end).cast("long").alias("minus"), F.get(h, i)["term"].alias("term"), before(end)["source"].alias("source"),
        ))))

    def ranked(all_: Column, dim: str) -> Column:
        mine = F.slice(F.sort_array(F.filter(all_, lambda x: x["dimension"] == dim)), 1, n)
        return F.transform(mine, lambda x, r: F.struct(
            x["dimension"].alias("dimension"), x["term"].alias("term"), x["source"].alias("source"), (-x["minus"]).alias("count"), (r + 1).cast("int").alias("rank")
        ))

    sorted_hits = F.sort_array(F.flatten(F.transform(scored, hits)))
    return let(let(sorted_hits, counted), lambda all_: F.concat(*[ranked(all_, dim) for dim in SCORES]))


def analyses(documents: DataFrame, scored: str = "scored", sentences: int = 20, terms: int = 25) -> DataFrame:
    """``documents`` with scores, coverage, tallies and top_sentences in place of their array of scored sentences: the nested rows that
    ``write_signals`` stores. Tallies are the ``terms`` most frequent of each dimension, in order of dimension and rank; a document without
    scored sentence has zero scores and coverage and empty lists. Nothing leaves its row, so nothing is shuffled."""
    x = F.col(scored)
    tallies = F.sort_array(F.transform(tally_of(x, terms), lambda t: F.struct(*[t[c].alias(c) for c in ("dimension", "rank", "term", "source", "count")])))
    tops = F.transform(top_of(x, sentences), lambda s: F.struct(*[s[c].alias(c) for c in ("rank", "sent_id", "section", "text", *SCORES, "net_score")]))
    rest = [c for c in documents.columns if c != scored]
    return documents.select(*rest, scores_of(x).alias("scores"), coverage_of(x).alias("coverage"), tallies.alias("tallies"), tops.alias("top_sentences"))


def phrase_table(tally: DataFrame, n: int = 4) -> DataFrame:
    return tally.where(F.col("rank") <= n)


def bin_name(value: Column) -> Column:
    out = F.when((value >= BINS[0]) & (value <= BINS[1]), BIN_NAMES[0])
    for low, high, name in zip(BINS[1:], BINS[2:], BIN_NAMES[1:], strict=False):
        out = out.when((value > low) & (value <= high), name)
    return out


def net_histogram(df: DataFrame, net: str = "net_score") -> DataFrame:
    """(ord, bin, n): empty bins with 0; values outside all bins are left out. The bins are six literal rows."""
    bins = df.sparkSession.createDataFrame(list(enumerate(BIN_NAMES)), "ord int, bin string")
    counts = df.select(bin_name(F.col(net)).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counts, "bin", "left").select("ord", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def evidence_table(top: DataFrame, n: int = 10, width: int = 100) -> DataFrame:
    """The first ``n`` of a document's top sentences, cut, with joined hit lists."""
    cut = F.when(F.length("text") > width, F.concat(F.substring("text", 1, width), F.lit("…"))).otherwise(F.col("text"))
    join = lambda *c: F.array_join(F.concat(*c), ", ")
    return top.where(F.col("rank") <= n).select(
        "doc_id", "rank", cut.alias("text"), join("growth_lm", "growth_phrases").alias("growth_terms"),
        join("risk_lm", "risk_phrases").alias("risk_terms"), join("cost_phrases").alias("cost_terms"),
    )


def strongest_dimension(df: DataFrame) -> DataFrame:
    """``strongest``: the dimension of largest absolute score, growth before risk before cost."""
    best = F.greatest(*[F.abs(c) for c in SCORES])
    out = reduce(lambda acc, c: F.when(F.abs(c) == best, c).otherwise(acc), reversed(SCORES[:-1]), F.lit(SCORES[-1]))
    return df.withColumn("strongest", out)


def dominant_term(tally: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dominant_term): the first of the growth, then risk, then cost terms."""
    at = F.when(F.col("dimension") == "growth", 0).when(F.col("dimension") == "risk", 1).otherwise(2)
    return tally.groupBy(key).agg(F.min_by("term", F.struct(at, F.col("rank"))).alias("dominant_term"))


def dominant_of(tally: Column) -> Column:
    """The same inside the row: ``tally_of`` lists growth, risk and cost terms in that order, each by rank."""
    return F.get(tally, F.lit(0))["term"]


def comparison_rows(documents: DataFrame, zscores: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Flat rows; z columns are null without z-scores."""
    if zscores is None:
        return documents.withColumns({c: F.lit(None).cast("double") for c in ("z_growth", "z_risk", "z_net")})
    return documents.join(zscores.select(key, "z_growth", "z_risk", "z_net"), key, "left")


def metric_melt(rows: DataFrame, label: str = "label", z: bool = False) -> DataFrame:
    """(label, metric, value): raw scores, or z-scores with null as 0 (cost has none)."""
    cols = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("z_growth", "z_risk", "z_net")] if z else [F.col(c) for c in [*SCORES, "net_operating_signal"]]
    wide = rows.select(label, *cols)
    return wide.unpivot([label], wide.columns[1:], "metric", "value")


def net_trend(rows: DataFrame, group: str, order: list[str], lag: int | None = None) -> DataFrame:
    """Net scores in order; with ``lag`` also the difference to that many rows before in the group."""
    if lag is None:
        return rows
    return rows.withColumn("net_change", F.col("net_operating_signal") - F.lag("net_operating_signal", lag).over(W.partitionBy(group).orderBy(*order)))


def latest_report(documents: DataFrame, tickers: DataFrame, ticker: str = "ticker", date: str = "filing_date", least: int = 50) -> DataFrame:
    """One row for every ticker asked for: its latest report, whether it has few scored sentences, or that it is missing."""
    w = W.partitionBy(ticker).orderBy(F.desc(date), "doc_id")
    last = documents.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    out = tickers.select(F.col(ticker)).distinct().join(last, ticker, "left")
    return out.withColumn("missing", F.col("doc_id").isNull()).withColumn("low_coverage", F.coalesce(F.col("scored") <= least, F.lit(False)))
