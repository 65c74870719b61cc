"""Queries of sources, preparation, cleaning and incremental work (rows S, R, C, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import cleaning
from ..operators import preparation as prep
from ..sources import records as src
from ..streaming import incremental
from . import corpus as c
from .corpus import RECORDS, Query, records, table

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BASIC = "doc_id, ticker, form_type, filing_date"


@query(f"WITH {RECORDS} SELECT {BASIC}, CAST(length(raw_text) AS BIGINT) AS n_chars FROM records WHERE form_type = '10-K'")
def s1_read_records(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    records(spark, sf).write.json(path)
    good, _ = src.read_records(spark, [path], form="10-k", schema="doc_id long, ticker string, form_type string, filing_date string, raw_text string", multi_line=False)
    return good.select("doc_id", "ticker", "form_type", "filing_date", F.length("raw_text").cast("long").alias("n_chars"))


@query(f"WITH {RECORDS} SELECT {BASIC}, 'raw' AS data_source FROM records")
def s2_load_analysis_input(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).drop("raw_text")
    return src.first_available([("processed", r.where("ticker = 'NONE'")), ("raw", r), ("demo", r.limit(0))])


LEX = """lex AS (SELECT p_name AS w, CAST(p_size % 4 AS VARCHAR) AS pos, CAST(p_partkey % 3 AS VARCHAR) AS neg, CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '2009' END AS unc FROM part),
cat AS (SELECT DISTINCT lower(trim(w)) AS word, category FROM (SELECT w, 'growth' AS category FROM lex WHERE pos <> '0' UNION ALL SELECT w, 'risk' FROM lex WHERE neg <> '0'
 UNION ALL SELECT w, 'uncertainty' FROM lex WHERE unc <> 'x'))"""


def lexicon_csv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_name").alias("Word"), (F.col("p_size") % 4).cast("string").alias("Positive"), (F.col("p_partkey") % 3).cast("string").alias("Negative"),
        F.lit("0").alias("Litigious"), F.lit("").alias("Constraining"), F.when(F.col("p_partkey") % 7 == 0, "x").otherwise("2009").alias("Uncertainty"),
    )


@query(f"WITH {LEX} SELECT * FROM cat WHERE NOT (category = 'growth' AND word = 'small ring')")
def s3_read_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    lexicon_csv(spark, sf).write.option("header", True).csv(path)
    return src.read_lexicon(spark, path, blocked={"growth": ["small ring"]})


@query("SELECT upper(source) AS ticker, lang AS filing_date, source AS company_name, 'EARNINGS_CALL' AS form_type, CAST(length(text) AS BIGINT) AS text_length FROM documents WHERE source IN ('src1', 'src2', 'src3')")
def s4_bulk_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("source").alias("Symbol"), F.col("text").alias("Transcript"), F.col("lang").alias("date"), F.col("source").alias("company"))
    return src.bulk_transcripts(d, ["src1", "SRC2", "Src3"]).select("ticker", "filing_date", "company_name", "form_type", F.col("text_length").cast("long").alias("text_length"))


@query("SELECT o_custkey AS company, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS pos, o_orderpriority AS form, o_orderkey AS accession FROM orders")
def s5_unnest_feed(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority")))
    feed = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company")).agg(rows.alias("rows"))
    feed = feed.select("company", F.struct(F.col("rows.o_orderpriority").alias("form"), F.col("rows.o_orderkey").alias("accession")).alias("recent"))
    return src.unnest_feed(feed, "recent", ["form", "accession"])


@query(f"WITH {RECORDS} SELECT doc_id, ticker, form_type, filing_date, CAST(CASE WHEN filing_date = 'n/a' THEN 0 ELSE CAST(substr(filing_date, 1, 4) AS INTEGER) END AS INTEGER) AS year FROM records")
def s6_write_signals(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    src.write_signals(records(spark, sf).drop("raw_text"), path)
    return spark.read.parquet(path).select("doc_id", "ticker", "form_type", "filing_date", F.col("year").cast("int").alias("year"))


@query(f"WITH {RECORDS} SELECT {BASIC} FROM records")
def s7_write_index(spark: SparkSession, sf: str) -> DataFrame:
    path = c.scratch(spark)
    src.index_rows(records(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {RECORDS} SELECT {BASIC}, '1.0' AS version, (SELECT count(*) FROM records) AS n_records FROM records")
def s8_versioned_index(spark: SparkSession, sf: str) -> DataFrame:
    return src.versioned_index(src.index_rows(records(spark, sf)), "1.0")


@query("SELECT doc_id AS id, text, CASE label WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS true_label FROM (SELECT d.doc_id, d.text, CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 2 ELSE 1 END AS label FROM documents d JOIN labels USING (doc_id))")
def s10_read_labelled(spark: SparkSession, sf: str) -> DataFrame:
    return src.labelled(labelled_items(spark, sf))


def labelled_items(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("doc_id").alias("id"), "text", label.alias("label"))


@query(f"WITH {RECORDS} SELECT doc_id, r.ticker, lpad(CAST(s_suppkey * 37 AS VARCHAR), 10, '0') AS cik FROM records r JOIN supplier ON r.ticker = 'SRC' || s_suppkey AND s_suppkey <= 15")
def r1_resolve_cik(spark: SparkSession, sf: str) -> DataFrame:
    reg = table(spark, sf, "supplier").where("s_suppkey <= 15").select(F.concat(F.lit("src"), "s_suppkey").alias("ticker"), (F.col("s_suppkey") * 37).alias("cik"))
    return prep.resolve_cik(records(spark, sf).select("doc_id", "ticker"), reg)


EV = "ev AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 10 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events)"


def feed_rows(spark: SparkSession, sf: str) -> DataFrame:
    day = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", day.alias("date"))


@query(f"WITH {EV} SELECT * FROM ev WHERE event_type IN ('click', 'view') AND (date = 'bad' OR (date >= '2024-01-05' AND date <= '2024-01-20'))")
def r2_filter_forms_dates(spark: SparkSession, sf: str) -> DataFrame:
    return prep.filter_forms_dates(feed_rows(spark, sf), ["click", "view"], "2024-01-05", "2024-01-20", form="event_type")


@query(f"WITH {EV} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 2")
def r3_first_n_per_form(spark: SparkSession, sf: str) -> DataFrame:
    return prep.first_n_per_form(feed_rows(spark, sf), 2, "user_id", "event_type", "event_id")


@query("SELECT page_id, CASE WHEN length(x) > 500 THEN x END AS text FROM (SELECT page_id, regexp_replace(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&[a-zA-Z]+;', ' ', 'g') AS x FROM pages)")
def r4_strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", t.strip_html(F.col("html")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'on ' || strftime(o_orderdate, '%Y') END AS date FROM orders")
def r5_normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, "o_orderdate"
    raw = F.lit(None).cast("string")
    for i, f in enumerate(t.DATE_FORMATS):
        raw = F.when(k == i, F.date_format(d, f)).otherwise(raw)
    raw = F.coalesce(raw, F.concat(F.lit("on "), F.date_format(d, "yyyy")))
    return table(spark, sf, "orders").select("o_orderkey", t.normalize_date(raw).alias("date"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE 'Q' || (o_orderkey % 5 + 1) END AS quarter, CASE WHEN o_orderkey % 10 >= 2 THEN CAST(1998 + o_orderkey % 10 AS VARCHAR) ELSE '' END AS year FROM orders")
def r6_quarter_year(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    title = F.concat(F.lit("results q"), (k % 5 + 1).cast("string"), F.lit(" "), (k % 10 + 1998).cast("string"), F.lit(" call"))
    return table(spark, sf, "orders").select("o_orderkey", t.quarter(title).alias("quarter"), t.year(title).alias("year"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'T' || c_custkey || 'X' ELSE trim(c_name) END AS company_name FROM customer")
def r7_company_name(spark: SparkSession, sf: str) -> DataFrame:
    ticker = F.concat(F.lit("T"), F.col("c_custkey").cast("string"), F.lit("X"))
    title = F.when(F.col("c_custkey") % 4 == 0, F.concat(ticker, F.lit(" call"))).otherwise(F.concat("c_name", F.lit(" ("), F.lower(ticker), F.lit(") Q1")))
    return table(spark, sf, "customer").select("c_custkey", t.company_name(title, ticker).alias("company_name"))


@query("SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3")
def r8_dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return prep.dedup_keep_first(table(spark, sf, "events"), "event_type", "user_id", "event_id", 3)


@query("SELECT * FROM (SELECT doc_id, array_to_string([x for x in string_split(text, chr(10)) if length(trim(x)) > 50], chr(10)) AS text FROM documents) WHERE length(text) >= 200")
def r9_drop_short_text(spark: SparkSession, sf: str) -> DataFrame:
    return prep.drop_short_text(table(spark, sf, "documents").select("doc_id", "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[TEXT EXTRACTION FAILED]' ELSE text END AS raw_text, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE length(text) END AS text_length FROM documents")
def r10_extraction_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("text")).alias("raw_text"))
    return prep.extraction_sentinel(d).withColumn("text_length", F.col("text_length").cast("long"))


@query(f"WITH {RECORDS} SELECT CASE WHEN grouping(form_type) = 0 THEN 'form' WHEN grouping(ticker) = 0 THEN 'ticker' ELSE 'total' END AS by, coalesce(form_type, ticker) AS key, count(*) AS n, CAST(count(*) FILTER (filing_date = 'n/a') AS BIGINT) AS failed FROM records GROUP BY GROUPING SETS ((form_type), (ticker), ())")
def r11_collection_summary(spark: SparkSession, sf: str) -> DataFrame:
    return prep.collection_summary(records(spark, sf), failed="filing_date = 'n/a'")


LABEL_SQL = "ticker || ' | ' || form_type || ' | ' || filing_date"


@query(f"WITH {RECORDS} SELECT doc_id, {LABEL_SQL} AS label, false AS missing FROM records WHERE ticker IN ('SRC3', 'SRC4') UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), {LABEL_SQL} || ' (amended)', true FROM records WHERE ticker = 'SRC4'")
def r12_document_label(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by their labels, and the labels asked for that no document has."""
    r = records(spark, sf).select("doc_id", "ticker", prep.document_label().alias("label"))
    wanted = r.where("ticker IN ('SRC3', 'SRC4')").select("label")
    amended = r.where("ticker = 'SRC4'").select(F.concat("label", F.lit(" (amended)")).alias("label"))
    found, missing = prep.lookup_labels(r, wanted.unionByName(amended))
    none = missing.select(F.lit(None).cast("long").alias("doc_id"), "label", F.lit(True).alias("missing"))
    return found.select("doc_id", "label", F.lit(False).alias("missing")).unionByName(none)


@query(f"WITH {RECORDS} SELECT {BASIC} FROM records WHERE ticker IN ('SRC5', 'SRC6') AND form_type IN ('10-K', '8-K') AND (filing_date = 'n/a' OR substr(filing_date, 1, 4) = '2021')")
def r13_filter_analyses(spark: SparkSession, sf: str) -> DataFrame:
    return prep.filter_analyses(records(spark, sf).drop("raw_text"), ["src5", "src6"], ["10-k", "8-K"], [2021])


FILING = "filing AS (SELECT doc_id, 'Page ' || doc_id || ' of 99  “' || text || '”  us-gaap:Revenues ..... 12' || chr(10) || chr(10) || chr(10) || chr(10) || 'end .' AS text FROM documents)"


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    parts = [F.lit("Page "), F.col("doc_id").cast("string"), F.lit(" of 99  “"), F.col("text"), F.lit("”  us-gaap:Revenues ..... 12\n\n\n\nend .")]
    return d.select("doc_id", F.concat(*parts).alias("raw_text"))


def _clean_sql(x: str) -> str:
    x = f"translate({x}, chr(160) || '–—‘’“”', ' --' || chr(39) || chr(39) || '\"\"')"
    x = f"replace({x}, chr(8203), '')"
    for p in t.BOILERPLATE:
        x = f"regexp_replace({x}, '{p}', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\s+([.,;:!?])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"WITH {FILING} SELECT doc_id, {_clean_sql('text')} AS text FROM filing")
def c1_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean(dirty(spark, sf)).select("doc_id", "text")


@query(f"WITH {FILING} SELECT doc_id, {_clean_sql("text || ' fin'")} AS text FROM filing")
def c1_decoded_text(spark: SparkSession, sf: str) -> DataFrame:
    """The same texts as filings have them: with character references and a ligature, which decoding takes away again."""
    raw = F.concat(F.replace("raw_text", F.lit("&"), F.lit("&amp;")), F.lit(" &#64257;n"))
    for character, reference in (("“", "&#8220;"), ("”", "&rdquo;")):
        raw = F.replace(raw, F.lit(character), F.lit(reference))
    return cleaning.clean(dirty(spark, sf).withColumn("raw_text", raw), decode=True).select("doc_id", "text")


#: A report out of each document: its lines under four headers and one mention of an item; every third is one line, some have mentions only.
REPORT = """report AS (SELECT doc_id, form_type, CASE WHEN doc_id % 3 = 1 THEN replace(text, chr(10), ' ') ELSE text END AS text FROM (SELECT doc_id, CASE lang WHEN 'en' THEN '10-K' WHEN 'de' THEN '10-Q' ELSE '8-K' END AS form_type,
 CASE WHEN doc_id % 20 = 7 THEN 'As said above, see Item 7: of the report. ' || text ELSE
 'Front' || chr(10) || 'Item 1A. Risk Factors' || chr(10) || text || chr(10) || 'as in Item 7: of the report may grow.' || chr(10) ||
 'Item 7. Management''s Discussion and Analysis' || chr(10) || text || chr(10) || 'Item 7A - Management''s discussion and analysis' || chr(10) || 'short' || chr(10) || 'Item 8. Statements' || chr(10) || 'numbers' END AS text FROM documents))"""
ITEM_SQL = cleaning.ITEM.replace("(?=[a-z])([^\\n]{0,120})", "([a-z][^\\n]{0,119})")
HEADERS = REPORT + f""",
hp AS (SELECT doc_id, text, string_split(regexp_replace(text, '{ITEM_SQL}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM report WHERE form_type <> '8-K'),
hc AS (SELECT doc_id, text, p[i] AS piece, CAST(1 + list_sum([length(x) for x in p[1:i - 1]]) AS BIGINT) AS start FROM (SELECT doc_id, text, p, unnest(range(2, len(p) + 1)) AS i FROM hp)),
hr AS (SELECT *, regexp_extract(piece, '{ITEM_SQL}', 2) AS title FROM hc WHERE NOT regexp_matches(regexp_extract(piece, '{ITEM_SQL}', 2), '{cleaning.CROSS_REFERENCE}')),
headers AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) AS INTEGER) AS pos, upper(regexp_extract(piece, '{ITEM_SQL}', 1)) AS number, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title,
 regexp_replace(substr(text, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text) + 1) - start), '^\\s+|\\s+$', '', 'g') AS body FROM hr)"""
PICK = HEADERS + """,
kinds AS (SELECT *, 'mdna' AS section FROM headers WHERE regexp_matches(title, '(?i)management''?s\\s+discussion\\s+and\\s+analysis') UNION ALL SELECT *, 'risk_factors' FROM headers WHERE regexp_matches(title, '(?i)risk\\s+factors')),
picked AS (SELECT doc_id, section, body FROM kinds QUALIFY row_number() OVER (PARTITION BY doc_id, section ORDER BY length(body) DESC, pos) = 1)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    form = F.when(F.col("lang") == "en", "10-K").when(F.col("lang") == "de", "10-Q").otherwise("8-K")
    text = F.concat(
        F.lit("Front\nItem 1A. Risk Factors\n"), F.col("text"), F.lit("\nas in Item 7: of the report may grow.\nItem 7. Management's Discussion and Analysis\n"),
        F.col("text"), F.lit("\nItem 7A - Management's discussion and analysis\nshort\nItem 8. Statements\nnumbers"),
    )
    text = F.when(F.col("doc_id") % 20 == 7, F.concat(F.lit("As said above, see Item 7: of the report. "), F.col("text"))).otherwise(text)
    text = F.when(F.col("doc_id") % 3 == 1, F.replace(text, F.lit("\n"), F.lit(" "))).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", form.alias("form_type"), text.alias("text"))


@query(f"WITH {HEADERS} SELECT * FROM headers")
def c2_item_headers(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.item_headers(reports(spark, sf).where("form_type <> '8-K'"))


@query(f"WITH {PICK} SELECT * FROM picked")
def c3_pick_section(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.pick_sections(reports(spark, sf).where("form_type <> '8-K'"))


CUES = ["will", "may", "the"]
FORWARD = "array_to_string([s for s in string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) if contains(lower(s), 'will') OR contains(lower(s), 'may') OR contains(lower(s), 'the')], ' ')"
SECTIONS = PICK + f""",
wide AS (SELECT r.doc_id, CASE WHEN r.form_type = '8-K' OR NOT regexp_matches(r.text, '{ITEM_SQL}') THEN r.text ELSE coalesce(m.body, '') END AS mdna, coalesce(k.body, '') AS risk, r.text FROM report r
 LEFT JOIN picked m ON m.doc_id = r.doc_id AND m.section = 'mdna' LEFT JOIN picked k ON k.doc_id = r.doc_id AND k.section = 'risk_factors'),
secs AS (SELECT doc_id, 0 AS section_ord, 'mdna' AS section, mdna AS body FROM wide UNION ALL SELECT doc_id, 1, 'risk_factors', risk FROM wide
 UNION ALL SELECT doc_id, 2, 'forward_guidance', {FORWARD.format("CASE WHEN mdna <> '' THEN mdna ELSE text END")} FROM wide)"""


@query(f"WITH {SECTIONS} SELECT doc_id, section, body FROM secs WHERE section = 'mdna' AND body <> ''")
def c4_section_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.report_sections(reports(spark, sf), cues=CUES).where("section = 'mdna'").select("doc_id", "section", "body")


@query(f"SELECT doc_id, {FORWARD.format('text')} AS guidance FROM documents")
def c5_forward_guidance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.forward_sentences(F.col("text"), CUES).alias("guidance"))


CALL = """calls AS (SELECT conv_id AS doc_id, 'Opening words.' || chr(10) || 'Questions and Answers' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'Jane Doe -- Research Analyst' WHEN 'assistant' THEN 'John A. Roe -- Chief Officer'
 ELSE 'Op Erator -- Operator' END || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""
QA = f"regexp_replace(substr(text, length(regexp_extract(text, '(?is)^.*?{cleaning.QUESTIONS.removeprefix('(?i)')}')) + 1), '^\\s+|\\s+$', '', 'g')"
TURNS = CALL + f""",
tp AS (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos FROM (SELECT doc_id, string_split(regexp_replace({QA}, '{cleaning.SPEAKER.replace("'", "''")}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM calls)),
tq AS (SELECT doc_id, pos, trim(regexp_extract(piece, '{cleaning.SPEAKER.replace("'", "''")}', 1)) AS speaker, trim(regexp_extract(piece, '{cleaning.SPEAKER.replace("'", "''")}', 2)) AS title,
 regexp_replace(regexp_replace(piece, '(?s)\\A(?:{cleaning.SPEAKER.replace("'", "''")})', ''), '^\\s+|\\s+$', '', 'g') AS text FROM tp WHERE pos > 0),
turns AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS turn_idx, speaker, title,
 CASE WHEN regexp_matches(lower(title), 'analyst|research|capital|securities|bank') THEN 'Q' ELSE 'A' END AS role, text FROM tq WHERE text <> '')"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("role") == "user", "Jane Doe -- Research Analyst").when(F.col("role") == "assistant", "John A. Roe -- Chief Officer").otherwise("Op Erator -- Operator")
    conv = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.concat(head, F.lit("\n"), "text").alias("said"))
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "said"))), lambda x: x["said"])
    return conv.groupBy("doc_id").agg(F.concat(F.lit("Opening words.\nQuestions and Answers\n"), F.array_join(said, "\n")).alias("text"))


@query(f"WITH {CALL} SELECT doc_id, 'Opening words.' AS remarks, {QA} AS qa_body FROM calls")
def c6_split_transcript(spark: SparkSession, sf: str) -> DataFrame:
    remarks, qa = cleaning.split_transcript(F.col("text"))
    return calls(spark, sf).select("doc_id", remarks.alias("remarks"), qa.alias("qa_body"))


@query(f"WITH {TURNS} SELECT * FROM turns")
def c7_parse_turns(spark: SparkSession, sf: str) -> DataFrame:
    _, qa = cleaning.split_transcript(F.col("text"))
    return cleaning.parse_turns(calls(spark, sf).select("doc_id", qa.alias("qa_body")))


@query(f"WITH {TURNS} SELECT role, count(*) AS n FROM turns GROUP BY role")
def c8_speaker_role(spark: SparkSession, sf: str) -> DataFrame:
    return c7_parse_turns(spark, sf).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SECTIONS}, {TURNS} SELECT doc_id, section_ord, section, CAST(length(body) AS BIGINT) AS n_chars FROM secs WHERE body <> '' UNION ALL SELECT doc_id + 1000000000, 0, 'prepared_remarks', 14 FROM calls UNION ALL SELECT doc_id + 1000000000, turn_idx + 1, 'qa_' || role || '_' || turn_idx, CAST(length(text) AS BIGINT) FROM turns")
def c9_route_by_form(spark: SparkSession, sf: str) -> DataFrame:
    calls_ = calls(spark, sf).select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), F.lit("EARNINGS_CALL").alias("form_type"), "text")
    out = cleaning.route_by_form(reports(spark, sf).unionByName(calls_), cues=CUES)
    return out.select("doc_id", "section_ord", "section", F.length("body").cast("long").alias("n_chars"))


@query(f"WITH {RECORDS} SELECT {BASIC} FROM records WHERE ticker || form_type || filing_date NOT IN (SELECT ticker || form_type || filing_date FROM records WHERE doc_id % 3 = 0)")
def j1_incremental_process(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).drop("raw_text")
    return incremental.unprocessed(r, r.where("doc_id % 3 = 0"))


@query(f"WITH {RECORDS} SELECT {BASIC}, '1.' || (doc_id % 2) AS version FROM records WHERE doc_id % 2 = 0")
def j2_stale_version(spark: SparkSession, sf: str) -> DataFrame:
    done = records(spark, sf).drop("raw_text").withColumn("version", F.concat(F.lit("1."), (F.col("doc_id") % 2).cast("string")))
    return incremental.stale(done, "1.1")


@query("SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def j1_stream(spark: SparkSession, sf: str) -> DataFrame:
    source, sink, checkpoint = (c.scratch(spark) for _ in range(3))
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    process = lambda df: df.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
    for k in range(2):  # two arrivals of files, each processed once
        d.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(source)
        incremental.process_new_files(spark, source, d.schema, process, sink, checkpoint)
    return spark.read.parquet(sink)


@query(f"WITH {RECORDS} SELECT ticker, form_type, filing_date, CAST(max(length(raw_text)) AS BIGINT) AS n_chars FROM records GROUP BY ALL")
def j1_stream_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Reports that are delivered again, in a later file: each key is processed once."""
    source, sink, checkpoint = (c.scratch(spark) for _ in range(3))
    r = records(spark, sf).groupBy("ticker", "form_type", "filing_date").agg(F.max(F.length("raw_text")).cast("long").alias("n"))
    r = c.once(r)
    process = lambda df: df.select("ticker", "form_type", "filing_date", F.col("n").alias("n_chars"))
    for k in range(3):  # the second delivery holds the first's rows again, the third some of both
        r.where(F.length("filing_date") + F.length("ticker") <= 10 + k).write.mode("append").parquet(source)
        incremental.process_new_records(spark, source, r.schema, process, sink, checkpoint)
    r.write.mode("append").parquet(source)
    incremental.process_new_records(spark, source, r.schema, process, sink, checkpoint)
    return spark.read.parquet(sink).drop("batch")
