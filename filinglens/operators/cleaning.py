"""Cleaning and segmentation (rows C1-C9): arrays of sections inside the row, or one row a section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dictionaries as d
from ..functions import text as t

MARK = "\u0001"
#: Headers of items and speakers, and what a title of a mere mention begins with.
ITEM = r"(?im)\bitem\s+(\d+[ab]?)(?:\s*[.\-:]\s{0,6}|\s{2,})(?=[a-z])([^\n]{0,120})"
CROSS_REFERENCE = (
    r"(?i)^\s*(?:of\s+(?:the|this|our)|in\s+(?:the|this|our)|under\s+(?:the|this|our)|described\s+in|discussed\s+in|referenced\s+in"
    r"|set\s+forth\s+in|to\s+the|included\s+in|and\s+(?:our|this)|see\s+(?:also|part)|for\s+(?:the|this|our|a)|we\s+|our\s+|this\s+"
    r"|these\s+|there\s+|any\s+|such\s+|if\s+|when\s+|because\s+|although\s+)"
)
SECTION_TITLES = {"mdna": r"(?i)management'?s\s+discussion\s+and\s+analysis", "risk_factors": r"(?i)risk\s+factors"}
SPEAKER = (
    r"(?m)^[ \t]*((?:[A-Z][A-Za-z.\-']{0,20})(?:\s+[A-Z][A-Za-z.\-']{0,20}){0,3})\s*(?:--|—)\s*([A-Za-z][A-Za-z,&/\- ]{2,80}?)[ \t]*$"
)
QUESTIONS = (
    r"(?i)(questions?\s*(?:&|and)\s*answers?|q\s*&\s*a\s*session|we\s+will\s+now\s+open\s+the\s+(?:call|line)\s+(?:up\s+)?for\s+questions)"
)
SEC_FORMS = ["10-K", "10-Q", "8-K"]
SECTIONED_FORMS = ["10-K", "10-Q"]


def clean(df: DataFrame, text: str = "raw_text", out: str = "text", decode: bool = False) -> DataFrame:
    """``decode`` adds character references and NFKC, the only step that leaves the JVM."""
    source = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(out, t.clean_text(t.decode_text(source) if decode else source))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before each match; the first piece is what stands before all of them. U+0001 in the text becomes U+0002."""
    marked = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK, "\u0002"), pattern, f"{MARK}$0")
    return F.split(marked, MARK, -1)


def _rest(pieces: Column) -> Column:
    return F.slice(pieces, F.lit(2), F.size(pieces))


def _headers(pieces: Column, pattern: str) -> Column:
    """array<struct<pos, number, title, body>> out of the pieces: those of mere mentions are put back to the header before, so that bodies
    follow each other without a gap. What stands before the first header is in none."""
    mention = lambda p: F.regexp_extract(p, pattern, 2).rlike(CROSS_REFERENCE)
    again = F.array_join(F.transform(_rest(pieces), lambda p: F.when(mention(p), p).otherwise(F.concat(F.lit(MARK), p))), "")
    bodies = t.let(F.split(again, MARK, -1), _rest)
    return F.transform(bodies, lambda b, i: F.struct(
        (i + 1).cast("int").alias("pos"), F.upper(F.regexp_extract(b, pattern, 1)).alias("number"), _trimmed(F.regexp_extract(b, pattern, 2)).alias("title"),
        _trimmed(b).alias("body"),
    ))


def header_bodies(text: Column, pattern: str = ITEM) -> Column:
    """array<struct<pos, number, title, body>>: the headers of a text in order, without mere mentions; a body runs from its header's start to the
    next header's. Found and cut inside the row."""
    return t.let(_pieces(text, pattern), lambda p: _headers(p, pattern))


def item_headers(df: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = ITEM) -> DataFrame:
    """(key, pos, number, title, body): a row a header. Documents without one have no rows."""
    return df.select(key, F.inline(header_bodies(F.col(text), pattern)))


def _longest(headers: Column, title: str) -> Column:
    """The longest body of the headers with such a title, the first of equal ones; null without one."""
    mine = F.filter(headers, lambda h: h["title"].rlike(title))
    return F.array_max(F.transform(mine, lambda h: F.struct(F.length(h["body"]).alias("n"), (-h["pos"]).alias("first"), h["body"].alias("body"))))["body"]


def pick_sections(df: DataFrame, key: str = "doc_id", text: str = "text", titles: dict[str, str] = SECTION_TITLES) -> DataFrame:
    """(key, section, body): the longest body among a section's headers."""
    picked = t.let(header_bodies(F.col(text)), lambda h: F.array(*[F.struct(F.lit(s).alias("section"), _longest(h, p).alias("body")) for s, p in titles.items()]))
    return df.select(key, F.inline(picked)).where("body IS NOT NULL")


def _section_rows(**bodies: Column) -> Column:
    """array<struct<section_ord, section, body>> of those that have any text."""
    rows = [F.struct(F.lit(i).alias("section_ord"), F.lit(n).alias("section"), c.alias("body")) for i, (n, c) in enumerate(bodies.items())]
    return F.filter(F.array(*rows), lambda x: x["body"] != "")


def report_array(form: Column, text: Column, cues: list[str] = d.FORWARD_CUES) -> Column:
    """array<struct<section_ord, section, body>>: mdna, risk_factors and forward_guidance of a report, as far as they have any text.

    A form that isn't sectioned, or a text without any header, is mdna as a whole. A text whose headers are all mentions has neither
    mdna nor risk factors. Guidance comes from mdna, else from the whole text.
    """
    text = F.coalesce(text, F.lit(""))
    guided = lambda mdna, risk: t.let(mdna, lambda m: _section_rows(mdna=m, risk_factors=risk, forward_guidance=t.forward_sentences(F.when(m != "", m).otherwise(text), cues)))
    found = lambda h, s: F.coalesce(_longest(h, SECTION_TITLES[s]), F.lit(""))
    whole = guided(text, F.lit(""))
    by_items = t.let(_pieces(text, ITEM), lambda p: F.when(F.size(p) == 1, whole).otherwise(
        t.let(_headers(p, ITEM), lambda h: guided(found(h, "mdna"), found(h, "risk_factors")))
    ))
    return F.when(F.upper(F.trim(form)).isin(SECTIONED_FORMS), by_items).otherwise(whole)


def report_sections(df: DataFrame, key: str = "doc_id", form: str = "form_type", text: str = "text", cues: list[str] = d.FORWARD_CUES) -> DataFrame:
    """(key, section_ord, section, body): a row for each of ``report_array``."""
    return df.select(key, F.inline(report_array(F.col(form), F.col(text), cues)))


def split_transcript(text: Column) -> tuple[Column, Column]:
    """(prepared remarks, questions and answers) around the first marker; all remarks without one."""
    parts = F.split(F.regexp_replace(text, QUESTIONS, f"{MARK}"), MARK, 2)
    body = F.regexp_replace(F.try_element_at(F.split(F.regexp_replace(text, QUESTIONS, f"{MARK}$0{MARK}"), MARK, 3), F.lit(3)), MARK, "")
    return F.when(body.isNull(), text).otherwise(_trimmed(parts[0])), _trimmed(F.coalesce(body, F.lit("")))


def turn_array(body: Column, cues: list[str] = d.ANALYST_CUES) -> Column:
    """array<struct<speaker, title, role, text>>: turns with something said, in order."""
    def turn(p: Column) -> Column:
        title = _trimmed(F.regexp_extract(p, SPEAKER, 2))
        return F.struct(
            _trimmed(F.regexp_extract(p, SPEAKER, 1)).alias("speaker"), title.alias("title"), speaker_role(title, cues).alias("role"),
            _trimmed(F.regexp_replace(p, rf"(?s)\A(?:{SPEAKER})", "")).alias("text"),
        )

    return F.filter(F.transform(t.let(_pieces(body, SPEAKER), _rest), turn), lambda x: x["text"] != "")


def parse_turns(df: DataFrame, key: str = "doc_id", body: str = "qa_body", cues: list[str] = d.ANALYST_CUES) -> DataFrame:
    """(key, turn_idx, speaker, title, role, text): turns with something said, numbered from 0."""
    rows = df.select(key, F.posexplode(turn_array(F.col(body), cues)).alias("turn_idx", "t"))
    return rows.select(key, "turn_idx", "t.speaker", "t.title", "t.role", "t.text")


def speaker_role(title: Column, cues: list[str] = d.ANALYST_CUES) -> Column:
    return F.when(F.lower(title).rlike("|".join(cues)), "Q").otherwise("A")


def transcript_array(text: Column) -> Column:
    """array<struct<section_ord, section, body>>: prepared_remarks, then qa_<role>_<i>."""
    remarks, qa = split_transcript(F.coalesce(text, F.lit("")))
    turns = F.transform(turn_array(qa), lambda x, i: F.struct(
        (i + 1).cast("int").alias("section_ord"), F.concat_ws("_", F.lit("qa"), x["role"], i.cast("string")).alias("section"), x["text"].alias("body")
    ))
    return F.concat(_section_rows(prepared_remarks=remarks), turns)


def transcript_sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_ord, section, body): a row for each of ``transcript_array``."""
    return df.select(key, F.inline(transcript_array(F.col(text))))


def section_array(form: Column, text: Column, cues: list[str] = d.FORWARD_CUES) -> Column:
    """Sections of a document of any form: reports by their items, all other forms as transcripts."""
    is_report = F.coalesce(F.upper(F.trim(form)).isin(SEC_FORMS), F.lit(False))
    return F.when(is_report, report_array(form, text, cues)).otherwise(transcript_array(text))


def route_by_form(df: DataFrame, key: str = "doc_id", form: str = "form_type", text: str = "text", cues: list[str] = d.FORWARD_CUES) -> DataFrame:
    """(key, section_ord, section, body): a row for each of ``section_array``. No step leaves the row, so nothing is shuffled."""
    return df.select(key, F.inline(section_array(F.col(form), F.col(text), cues)))
