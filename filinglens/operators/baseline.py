"""Sector baselines and z-scores (rows G1-G9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import millionths, ratio_of_millionths

CORPUS = "_corpus_all"
RELIABLE = 4
FLAT = 1e-9


def sector_for(df: DataFrame, sectors: DataFrame, ticker: str = "ticker") -> DataFrame:
    """``sector`` by upper-cased ticker, else Unknown."""
    s = sectors.select(F.upper("ticker").alias("_t"), F.col("sector").alias("sector"))
    out = df.drop("sector").join(s, F.upper(F.col(ticker)) == F.col("_t"), "left").drop("_t")
    return out.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))


def sector_coverage(sectors: DataFrame) -> DataFrame:
    """(sector, n, tickers)."""
    return sectors.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("ticker")).alias("tickers"))


def baseline_universe(df: DataFrame, sectors: DataFrame, only: list[str] | None = None, ticker: str = "ticker") -> DataFrame:
    """Rows of mapped tickers, of the sectors chosen; an unknown sector name is an error."""
    if only:
        known = {r.sector for r in sectors.where(F.col("sector").isin(only)).select("sector").distinct().collect()}
        if unknown := sorted(set(only) - known):
            raise ValueError(f"unknown sectors {unknown}")
        sectors = sectors.where(F.col("sector").isin(only))
    return df.join(sectors.select(F.upper("ticker").alias("_t")), F.upper(F.col(ticker)) == F.col("_t"), "left_semi")


def latest_per_ticker(df: DataFrame, ticker: str = "ticker", date: str = "filing_date", pos: str = "pos") -> DataFrame:
    """The row of greatest date text; of equal ones the first seen."""
    w = W.partitionBy(ticker).orderBy(F.desc(date), F.asc(pos))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


METRICS = ["growth", "risk"]


def _summed(df: DataFrame, sums: list[Column], tickers: Column, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*sums, F.sort_array(F.array_distinct(F.flatten(tickers))).alias("tickers"))


def baseline_state(df: DataFrame, engine: str = "v1", ticker: str = "ticker", sector: str = "sector") -> DataFrame:
    """(engine_version, sector, n, sums and sums of squares of growth and risk in whole millionths, tickers): a row a sector.

    All parts add up, so states of different reports merge (``merge_states``) into exactly the state of them all.
    """
    x = {m: F.coalesce(millionths(F.col(m)), F.lit(0)).cast("decimal(19,0)") for m in METRICS}
    rows = df.select(F.lit(engine).alias("engine_version"), F.col(sector).alias("sector"), F.array(F.col(ticker)).alias("_t"), *[c.alias(f"_{m}") for m, c in x.items()])
    sums = [F.count(F.lit(1)).alias("n")]
    for m in METRICS:
        sums += [F.sum(f"_{m}").cast("decimal(38,0)").alias(f"{m}_sum"), F.sum(F.col(f"_{m}") * F.col(f"_{m}")).cast("decimal(38,0)").alias(f"{m}_squares")]
    return _summed(rows, sums, F.collect_set("_t"), ["engine_version", "sector"])


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all reports out of those of disjoint parts of them."""
    return _merged(reduce(DataFrame.unionByName, states), ["engine_version", "sector"])


def _merged(states: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(c).cast(t).alias(c) for c, t in states.drop("tickers", *keys).dtypes]
    return _summed(states, sums, F.collect_list("tickers"), keys)


def _spread(m: str) -> Column:
    """The sample's standard deviation out of whole sums, to 4 digits; 1 for a single or flat one."""
    n = F.col("n").cast("decimal(18,0)")
    over = (n * F.col(f"{m}_squares") - F.col(f"{m}_sum") * F.col(f"{m}_sum")).cast("double")
    s = F.sqrt(F.greatest(over, F.lit(0.0)) / (F.col("n") * F.greatest(F.col("n") - 1, F.lit(1)))) / 1_000_000
    return F.when((F.col("n") <= 1) | (s <= FLAT), 1.0).otherwise(F.round(s, 4))


def stats_of(state: DataFrame) -> DataFrame:
    """A baseline row a sector and one an engine for all (``_corpus_all``) out of a state. Each row of the state counts for its
    sector and for all, in one flow: a union with the state summed anew would compute the reports twice."""
    each = state.withColumn("_all", F.explode(F.array(F.lit(False), F.lit(True))))
    each = each.withColumn("sector", F.when(F.col("_all"), CORPUS).otherwise(F.col("sector")))
    out = _merged(each, ["engine_version", "sector", "_all"])
    mean = lambda m: ratio_of_millionths(F.col(f"{m}_sum").cast("long"), F.col("n"), 4).alias(f"{m}_mean")
    stats = [c for m in METRICS for c in (mean(m), _spread(m).alias(f"{m}_stdev"))]
    return out.select("engine_version", F.col("sector").alias("reference"), "n", "tickers", (F.col("n") >= RELIABLE).alias("reliable"), *stats)


def baseline_stats(df: DataFrame, engine: str = "v1", ticker: str = "ticker", sector: str = "sector") -> DataFrame:
    """One row a sector and one for all (``_corpus_all``); reports are read and shuffled once, as partial sums a sector."""
    return stats_of(baseline_state(df, engine, ticker, sector))


def reference_label(reference: Column, n: Column) -> Column:
    """What a reader sees (fixed wording)."""
    return (
        F.when(reference == CORPUS, F.format_string(
            "All sectors combined (n=%d). Ticker not mapped to a specific sector, so compared against the full reference corpus. "
            "Sector-specific comparison would be more precise.", n))
        .when(reference == "no_baseline", F.lit("No baseline available; z-scores are zero."))
        .otherwise(F.format_string("%s sector peers (n=%d)", reference, n))
    )


def apply_zscores(documents: DataFrame, baseline: DataFrame) -> DataFrame:
    """Documents (with sector, growth, risk, engine_version) against their sector if it is reliable, else against all, else zeros.

    Net is the difference of the unrounded parts. The corpus row (one an engine) and the sector rows join by engine.
    """
    b = baseline.where((F.col("reference") == CORPUS) | F.col("reliable"))
    cols = ["reference", "n", "reliable", "growth_mean", "growth_stdev", "risk_mean", "risk_stdev"]
    own = b.where(F.col("reference") != CORPUS).select(F.col("engine_version").alias("_oe"), *[F.col(c).alias(f"o_{c}") for c in cols])
    all_ = b.where(F.col("reference") == CORPUS).select(F.col("engine_version").alias("_ae"), *[F.col(c).alias(f"a_{c}") for c in cols])
    df = documents.join(own, (F.col("engine_version") == F.col("_oe")) & (F.col("sector") == F.col("o_reference")), "left")
    df = df.join(all_, F.col("engine_version") == F.col("_ae"), "left")
    pick = lambda c: F.coalesce(F.col(f"o_{c}"), F.col(f"a_{c}"))
    z = lambda c: F.when(pick(f"{c}_stdev") < FLAT, 0.0).otherwise(F.coalesce((F.col(c) - pick(f"{c}_mean")) / pick(f"{c}_stdev"), F.lit(0.0)))
    reference, n = F.coalesce(pick("reference"), F.lit("no_baseline")), F.coalesce(pick("n"), F.lit(0))
    return df.select(
        *documents.columns, reference.alias("reference"), reference_label(reference, n).alias("reference_label"), n.alias("reference_n"),
        F.coalesce(pick("reliable"), F.lit(False)).alias("reliable"), F.col("o_reference").isNotNull().alias("is_sector_specific"),
        F.round(z("growth"), 3).alias("z_growth"), F.round(z("risk"), 3).alias("z_risk"), F.round(z("growth") - z("risk"), 3).alias("z_net"),
    )


def baseline_rows(baseline: DataFrame, shown: int = 8) -> DataFrame:
    """Flat rows for print: the corpus last, tickers cut to ``shown`` and how many more."""
    more = F.size("tickers") - shown
    listed = F.concat(F.array_join(F.slice("tickers", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
    name = F.when(F.col("reference") == CORPUS, "ALL (corpus)").otherwise(F.col("reference"))
    ord_ = F.struct((F.col("reference") == CORPUS).cast("int"), F.col("reference"))
    out = baseline.withColumn("ord", F.row_number().over(W.partitionBy("engine_version").orderBy(ord_)))
    return out.select("engine_version", "ord", name.alias("name"), "n", "reliable", "growth_mean", "growth_stdev", "risk_mean", "risk_stdev", listed.alias("tickers_shown"))
