"""The driver's tables as the entities of the library, in DataFrames and, for comparison, in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scoring, sentences

Query = Callable[[SparkSession, str], DataFrame]

#: Words that occur in the invented prose, in place of the finance lexicon.
STOP = ["the", "of", "and", "to", "a", "in"]
NEGATION, HEDGES = ["for"], ["as", "at"]
SCORER = scoring.Scorer(
    growth=["with", "from", "are"], risk=["this", "was"], uncertainty=["be"], growth_phrases=["is the"], risk_phrases=["in the"],
    cost_phrases=["on the"], negations=NEGATION, scope_negations=["for"],
)
PATTERN = r"[\p{L}\p{N}]+"
FEATURES = sentences.Features(STOP, NEGATION, HEDGES, PATTERN)
SECTION_OF = {"en": "mdna", "de": "risk_factors", "fr": "forward_guidance"}
FORM_OF = {"en": "10-K", "de": "10-Q", "fr": "8-K"}


#: A table of fewer bytes a core than this is often one row group, hence one task.
SMALL_SHARE = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of ``documents`` for work that is costly a row. Large tables come in as many tasks as they have row groups and are taken as
    they are; the rows of one too small for that are dealt over the cores first."""
    d = table(spark, sf_dir, "documents").select(*columns)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return d.repartition(cores) if size < cores * SMALL_SHARE else d


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one: spark.checkpoint.dir, else the session's checkpoint folder; on one machine without
    either a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='filinglens-')}"
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def by_value(c: Column, values: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def joined(c: str) -> Column:
    return F.array_join(c, ",").alias(c)


def r4(c: str | Column, name: str | None = None) -> Column:
    """Rounded to 4, without negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 4) + F.lit(0.0)).alias(name or c)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as filing records: source is the ticker, lang the form, doc_id gives the date (every 17th unreadable)."""
    d = table(spark, sf_dir, "documents")
    day = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")), "yyyy-MM-dd")
    return d.select(
        "doc_id", F.upper("source").alias("ticker"), by_value(F.col("lang"), FORM_OF, "EARNINGS_CALL").alias("form_type"),
        F.when(F.col("doc_id") % 17 == 0, "n/a").otherwise(day).alias("filing_date"), F.col("text").alias("raw_text"),
    )


def case(c: str, values: dict[str, str], other: str) -> str:
    return f"CASE {c} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())} ELSE '{other}' END"


RECORDS = f"""records AS (SELECT doc_id, upper(source) AS ticker, {case('lang', FORM_OF, 'EARNINGS_CALL')} AS form_type,
  CASE WHEN doc_id % 17 = 0 THEN 'n/a' ELSE strftime(DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER), '%Y-%m-%d') END AS filing_date, text AS raw_text
  FROM documents)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = texts(spark, sf_dir, "doc_id", "source", "lang", "text")
    return d.select("doc_id", "source", F.lit(0).alias("section_ord"), by_value(F.col("lang"), SECTION_OF, "qa_A_0").alias("section"), F.col("text").alias("body"))


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split_sentences(sections(spark, sf_dir), one_section=True)


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.add_features(split(spark, sf_dir), FEATURES)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.hit_columns(featured(spark, sf_dir), SCORER)


def scored_documents(spark: SparkSession, sf_dir: str, version: str = "v1") -> DataFrame:
    """(doc_id, source, scored): each document with the array of its scored sentences."""
    sents = sentences.sentence_array(F.array(F.struct("section", "body")))
    return sections(spark, sf_dir).select("doc_id", "source", held(scoring.scored_array(sents, SCORER, FEATURES, version)).alias("scored"))


def held(value: Column) -> Column:
    """``value``, computed once a row: a filter on it, also one that the optimiser adds before rows are unfolded, and columns out of it
    read what an unfolded array of one holds, in place of computing it anew."""
    return F.explode(F.array(value))


def scored(spark: SparkSession, sf_dir: str, version: str = "v1") -> DataFrame:
    """A row a scored sentence."""
    names = ["sent_id", "section", "text", "n_tokens", *scoring.HIT_LISTS, *scoring.SCORES, "net_score"]
    return scoring.scored_rows(split(spark, sf_dir), SCORER, FEATURES, version).select("doc_id", "source", *names)


def scored_first(spark: SparkSession, sf_dir: str, keys: DataFrame, versions: list[str]) -> DataFrame:
    """The scored first sentences of the documents of ``keys`` (doc_id)."""
    first = sentences.first_sentences(sections(spark, sf_dir), keys, one_section=True)
    return scoring.score_versions(sentences.add_features(first, FEATURES), SCORER, versions)


def once(df: DataFrame) -> DataFrame:
    """``df`` written and read again, where several steps use it."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: sents: doc_id, source, section, sent_id, text; feat adds tk, lem and flags; hit adds the six lists; raw the scores.
SENTS = f"""pieces AS (SELECT doc_id, source, {case('lang', SECTION_OF, 'qa_A_0')} AS section, unnest(p) AS text, generate_subscripts(p, 1) AS pos
  FROM (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)),
sents AS (SELECT doc_id, source, section, trim(text) AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS sent_id
  FROM pieces WHERE length(trim(text)) >= 3)"""
FEAT = SENTS + f""",
feat AS (SELECT *, list_distinct([x for x in tk if x NOT IN ({quoted(STOP)})]) AS lem, list_has_any(tk, [{quoted(NEGATION)}]) AS has_negation,
  list_has_any(tk, [{quoted(HEDGES)}]) AS has_hedge
  FROM (SELECT *, [lower(x) for x in regexp_extract_all(text, '{PATTERN}')] AS tk FROM sents))"""
HIT = FEAT + f""",
hit AS (SELECT *, list_sort(list_intersect(lem, [{quoted(SCORER.growth)}])) AS growth_lm, list_sort(list_intersect(lem, [{quoted(SCORER.risk)}])) AS risk_lm,
  list_sort(list_intersect(lem, [{quoted(SCORER.uncertainty)}])) AS uncertainty_lm,
  [p for p in [{quoted(SCORER.growth_phrases)}] if contains(lower(text), p)] AS growth_phrases,
  [p for p in [{quoted(SCORER.risk_phrases)}] if contains(lower(text), p)] AS risk_phrases,
  [p for p in [{quoted(SCORER.cost_phrases)}] if contains(lower(text), p)] AS cost_phrases FROM feat)"""
RAW = HIT + """,
raw AS (SELECT *, len(growth_lm)::DOUBLE + 2 * len(growth_phrases)::DOUBLE AS g0,
  len(risk_lm)::DOUBLE + len(uncertainty_lm)::DOUBLE * 0.5::DOUBLE + 2 * len(risk_phrases)::DOUBLE AS r0, 2 * len(cost_phrases)::DOUBLE AS c0 FROM hit)"""
WEIGHT = (
    "CASE WHEN section = 'mdna' THEN 1.0::DOUBLE WHEN section = 'forward_guidance' THEN 1.2::DOUBLE WHEN section = 'risk_factors' THEN 0.3::DOUBLE "
    "WHEN section = 'prepared_remarks' THEN 1.0::DOUBLE WHEN section LIKE 'qa\\_A%' ESCAPE '\\' THEN 1.1::DOUBLE WHEN section LIKE 'qa\\_Q%' ESCAPE '\\' THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"
)
NEGATED = {
    "v1": ("CASE WHEN has_negation THEN -g0 ELSE g0 END", "CASE WHEN has_negation THEN -r0 ELSE r0 END", "CASE WHEN has_negation THEN -c0 ELSE c0 END"),
    "v2": (
        "CASE WHEN has_negation AND len(growth_lm) + len(growth_phrases) > 0 THEN 0.0::DOUBLE ELSE g0 END",
        "CASE WHEN has_negation AND len(risk_lm) + len(risk_phrases) > 0 THEN 0.0::DOUBLE ELSE r0 END",
        "CASE WHEN has_negation THEN 0.0::DOUBLE ELSE c0 END",
    ),
    "v3": (
        "CASE WHEN len([i for i in range(1, len(tk) + 1) if tk[i] = 'for' AND list_has_any(list_slice(tk, greatest(i - 5, 1), i + 5), growth_lm)]) > 0 THEN 0.0::DOUBLE ELSE g0 END",
        "CASE WHEN len([i for i in range(1, len(tk) + 1) if tk[i] = 'for' AND list_has_any(list_slice(tk, greatest(i - 5, 1), i + 5), risk_lm)]) > 0 THEN 0.0::DOUBLE ELSE r0 END",
        "CASE WHEN has_negation THEN 0.0::DOUBLE ELSE c0 END",
    ),
}
LEAST = {"v1": 5, "v2": 3, "v3": 3}


def scores_sql(version: str = "v1") -> str:
    """The common table expressions up to ``sc``: scored sentences of a version."""
    g, r, c = NEGATED[version]
    w = f"* (CASE WHEN has_hedge THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * ({WEIGHT})"
    return RAW + f""",
sc AS (SELECT *, growth - risk AS net_score FROM (SELECT *, ({g}) {w} AS growth, ({r}) {w} AS risk, ({c}) {w} AS cost_pressure FROM raw WHERE len(tk) >= {LEAST[version]}))"""


def mean_s(expr: str, places: int = 4) -> str:
    """The mean to so many digits out of whole millionths."""
    total, unit = f"sum(CAST(round(({expr}) * 1000000) AS BIGINT))", 10 ** (6 - places)
    return f"sign({total}) * ((2 * abs({total}) + {unit} * count({expr})) // greatest({2 * unit} * count({expr}), 1)) / {10**places}::DOUBLE"


def j(c: str) -> str:
    return f"array_to_string({c}, ',') AS {c}"


def r4s(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 4) + 0.0 AS {name or expr}"
