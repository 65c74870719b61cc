"""Sources and sinks (rows S1-S10). Readers declare their schema; nothing is inferred by a second pass over the data."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dictionaries as d

RECORD = (
    "ticker string, company_name string, cik string, form_type string, filing_date string, quarter string, year string, title string, "
    "source string, source_url string, accession_number string, raw_text string, text_length int, collected_at string"
)
BASELINE = (
    "engine_version string, reference string, n long, tickers array<string>, reliable boolean, growth_mean double, growth_stdev double, "
    "risk_mean double, risk_stdev double"
)
#: Other names of a column in bulk files.
VARIANTS = {
    "ticker": ["ticker", "symbol"], "raw_text": ["transcript", "text"], "filing_date": ["date", "filing_date"],
    "company_name": ["company_name", "company"],
}


def read_records(
    spark: SparkSession, paths: list[str], form: str | None = None, schema: str = RECORD, multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON files, one record each (without ``multi_line``: one a line); names that begin with _ are skipped by Spark itself.
    A file that is no record is a row of ``errors`` (path, _corrupt_record)."""
    full = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.text(paths, wholetext=multi_line).select(F.col("_metadata.file_path").alias("path"), "value")
    df = raw.select("path", F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r")).select("path", "r.*")
    good = df.where("_corrupt_record IS NULL").drop("_corrupt_record", "path")
    if form:
        good = good.where(F.upper("form_type") == form.upper())
    return good, df.where("_corrupt_record IS NOT NULL").select("path", "_corrupt_record")


def first_available(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """The first table that has rows, with its name in ``data_source``; the last one if none has."""
    for name, df in stages[:-1]:
        if not df.isEmpty():
            return df.withColumn("data_source", F.lit(name))
    name, df = stages[-1]
    return df.withColumn("data_source", F.lit(name))


def lexicon_words(
    rows: DataFrame, columns: dict[str, list[str]] = d.LEXICON_COLUMNS, blocked: dict[str, list[str]] | None = None,
) -> DataFrame:
    """(word, category): lower-cased trimmed words with a non-zero whole-number flag in a column of the category, less blocked ones."""
    missing = {c for cs in columns.values() for c in cs} - set(rows.columns)
    if missing:
        raise ValueError(f"lexicon without columns {sorted(missing)}")
    blocked = {"growth": d.GROWTH_BLOCKED, "risk": d.RISK_BLOCKED} if blocked is None else blocked
    flag = lambda c: F.coalesce(F.trim(F.col(c).cast("string")).try_cast("int") != 0, F.lit(False))
    out = rows.withColumn("word", F.lower(F.trim("Word"))).where("word <> ''")
    member = F.array(*[F.when(reduce(lambda a, b: a | b, [flag(c) for c in cs]), F.lit(k)) for k, cs in columns.items() if cs])
    out = out.select("word", F.explode(F.array_compact(member)).alias("category")).distinct()
    pairs = [(w, c) for c, ws in blocked.items() for w in ws]
    if not pairs:
        return out
    return out.join(F.broadcast(rows.sparkSession.createDataFrame(pairs, "word string, category string")), ["word", "category"], "left_anti")


def read_lexicon(spark: SparkSession, path: str, **how) -> DataFrame:
    return lexicon_words(spark.read.option("header", True).csv(path), **how)


def bulk_transcripts(df: DataFrame, tickers: list[str] | None = None) -> DataFrame:
    """Rows of a bulk file under their usual names, of the wanted tickers (case-insensitively), with the text's length."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for name, variants in VARIANTS.items():
        found = [F.col(f"`{have[v]}`").cast("string") for v in variants if v in have]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    out = df.select(*cols).withColumn("ticker", F.upper("ticker")).withColumn("form_type", F.lit("EARNINGS_CALL"))
    if tickers:
        out = out.where(F.col("ticker").isin([t.upper() for t in tickers]))
    return out.withColumn("text_length", F.length("raw_text"))


def unnest_feed(df: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """One row for each position of a struct of parallel arrays; ``pos`` from 0."""
    zipped = F.arrays_zip(*[F.col(f"{column}.{f}").alias(f) for f in fields])
    return df.select(*[c for c in df.columns if c != column], F.posexplode(zipped).alias("pos", "x")).select(
        *[c for c in df.columns if c != column], "pos", *[F.col(f"x.{f}").alias(f) for f in fields]
    )


def write_signals(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested analyses, partitioned by form and year, so that readers prune by either."""
    year = F.coalesce(F.year(F.to_date(F.try_to_timestamp("filing_date", F.lit("yyyy-MM-dd")))), F.lit(0))
    df.withColumn("year", year).write.mode(mode).partitionBy("form_type", "year").parquet(path)


def index_rows(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Metadata of all records: everything but the text (which is then never read)."""
    return df.drop(text)


def versioned_index(df: DataFrame, version: str) -> DataFrame:
    """Rows with the version that made them and how many there are."""
    n = df.agg(F.count(F.lit(1)).alias("n_records"))
    return df.withColumn("version", F.lit(version)).crossJoin(F.broadcast(n))  # n is one row


def save_baseline(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The saved baseline; an empty table of its schema if there is none."""
    try:
        return spark.read.schema(BASELINE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], BASELINE)


def labelled(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(id, text, true_label) from a 0-based label number; other numbers are dropped."""
    names = names or d.LABELS
    label = F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))]), F.col("label").cast("int"))
    return df.withColumn("true_label", label).where("true_label IS NOT NULL").select("id", "text", "true_label")
