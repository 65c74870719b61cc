"""Record preparation (rows R1-R13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as t


def resolve_cik(records: DataFrame, registry: DataFrame, ticker: str = "ticker") -> DataFrame:
    """Records with their ten-digit ``cik``; tickers that the registry (ticker, cik) lacks are dropped."""
    r = registry.select(F.upper("ticker").alias("_t"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik"))
    return records.drop("cik").join(r, F.upper(F.col(ticker)) == F.col("_t")).drop("_t")


def filter_forms_dates(
    df: DataFrame, forms: list[str] | None = None, start: str | None = None, end: str | None = None, form: str = "form", date: str = "date",
) -> DataFrame:
    """Rows of the forms within inclusive dates; an unparseable date passes."""
    if forms:
        df = df.where(F.col(form).isin(forms))
    return df.where(t.in_dates(F.col(date), start, end))


def first_n_per_form(df: DataFrame, n: int, company: str = "company", form: str = "form", pos: str = "pos") -> DataFrame:
    """The first ``n`` rows of each company and form in feed order. The window becomes a top-n per group, cut before the shuffle."""
    w = W.partitionBy(company, form).orderBy(pos)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dedup_keep_first(df: DataFrame, key: str, group: str, pos: str, limit: int | None = None) -> DataFrame:
    """(group, key, pos) of the first occurrence of each key in its group, and of these the first ``limit``."""
    out = df.groupBy(group, key).agg(F.min(pos).alias(pos))
    return out if limit is None else first_n_per_form(out.withColumn("_all", F.lit(0)), limit, group, "_all", pos).drop("_all")


def drop_short_text(df: DataFrame, text: str = "text", least: int = 200, paragraph: int = 50) -> DataFrame:
    """Texts of their paragraphs over ``paragraph`` characters, joined by line feeds; texts under ``least`` are dropped."""
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda p: F.length(F.trim(p)) > paragraph), "\n")
    return df.withColumn(text, kept).where(F.length(text) >= least)


def extraction_sentinel(df: DataFrame, text: str = "raw_text", length: str = "text_length") -> DataFrame:
    """A failed (null) text becomes a marker of length 0."""
    return df.withColumn(length, F.coalesce(F.length(text), F.lit(0))).withColumn(
        text, F.coalesce(F.col(text), F.lit("[TEXT EXTRACTION FAILED]"))
    )


def collection_summary(df: DataFrame, form: str = "form_type", ticker: str = "ticker", failed: str = "text_length = 0") -> DataFrame:
    """(by, key, n, failed) by form, by ticker and in total, in one pass of grouping sets."""
    g = df.select(F.col(form).alias("f"), F.col(ticker).alias("k"), F.expr(failed).alias("bad"))
    sets = g.groupingSets([["f"], ["k"], []], "f", "k").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("failed")
    )
    by = F.when(F.col("gid") == 1, "form").when(F.col("gid") == 2, "ticker").otherwise("total")
    return sets.select(by.alias("by"), F.when(F.col("gid") == 1, F.col("f")).when(F.col("gid") == 2, F.col("k")).alias("key"), "n", "failed")


def document_label(ticker: str = "ticker", form: str = "form_type", date: str = "filing_date"):
    return F.concat_ws(" | ", ticker, form, F.col(date).cast("string"))


def lookup_labels(df: DataFrame, wanted: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows with a wanted label, wanted labels that no row has)."""
    w = wanted.select(label).distinct()
    return df.join(w, label, "left_semi"), w.join(df, label, "left_anti")


def filter_analyses(
    df: DataFrame, tickers: list[str] | None = None, forms: list[str] | None = None, years: list[int] | None = None,
    ticker: str = "ticker", form: str = "form_type", date: str = "filing_date",
) -> DataFrame:
    """Case-insensitive choice; no list, no filter; a date without a year passes."""
    if tickers:
        df = df.where(F.upper(F.col(ticker)).isin([x.upper() for x in tickers]))
    if forms:
        df = df.where(F.upper(F.col(form)).isin([x.upper() for x in forms]))
    if years:
        df = df.where(F.coalesce(F.substring(F.col(date).cast("string"), 1, 4).try_cast("int").isin(years), F.lit(True)))
    return df


def call_details(df: DataFrame, title: str = "title", ticker: str = "ticker") -> DataFrame:
    """``quarter``, ``year`` and ``company_name`` from a call's title."""
    return df.withColumns({
        "quarter": t.quarter(F.col(title)), "year": t.year(F.col(title)), "company_name": t.company_name(F.col(title), F.col(ticker)),
    })
