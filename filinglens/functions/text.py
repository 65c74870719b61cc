"""String and token columns (rows R4-R7, C1, C5, D2-D5, E1-E10)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as d

Words = list[str] | Column

#: What the cleaner deletes or replaces.
BOILERPLATE = [
    r"(?i)\bpage\s+\d+\s+of\s+\d+\b",
    r"(?im)^\s*page\s+\d+\s*$",
    r"\.{4,}\s*\d+",
    r"(?i)\b(?:xbrl|ixbrl|us-gaap|dei)[:\-][\w\-]+",
    r"(?is)united states\s+securities and exchange commission.*?washington,?\s*d\.?c\.?\s*20549",
]
CHARACTERS = {" ": " ", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "​": ""}
DATE_FORMATS = ["yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
MASKS = [
    (r"[$€£]\s?\d[\d,]*(?:\.\d+)?(?:\s?(?:million|billion|thousand|bn|mn|m|k)\b)?", "<MONEY>"),
    (r"\d[\d,]*(?:\.\d+)?\s?(?:%|percent\b)", "<PCT>"),
    (r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:,\s*\d{4})?", "<DATE>"),
    (r"\b\d{4}-\d{2}-\d{2}\b", "<DATE>"),
    (r"\b(?:19|20)\d{2}\b", "<DATE>"),
    (r"\b\d[\d,]*(?:\.\d+)?\b", "<NUM>"),
]


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also inside of lambdas, where the optimiser shares nothing."""
    return F.transform(F.array(value), use)[0]


def run_starts(ordered: Column, same) -> Column:
    """Where the runs of a sorted array begin; ``same(a, b)`` says whether two neighbours belong to one."""
    at = F.transform(ordered, lambda x, i: F.when((i == 0) | ~same(F.get(ordered, i - 1), x), i))
    return F.filter(at, lambda i: i.isNotNull())


def counted(ordered: Column) -> Column:
    """array<struct<value, n>> of a sorted array: each different value once."""
    def pairs(x: Column) -> Column:
        return let(run_starts(x, lambda a, b: a == b), lambda at: F.transform(at, lambda i, j: F.struct(
            F.get(x, i).alias("value"), (F.coalesce(F.get(at, j + 1), F.size(x)) - i).cast("long").alias("n")
        )))

    return let(ordered, pairs)


def words(values: Words) -> Column:
    return values if isinstance(values, Column) else F.array(*[F.lit(v) for v in values]).cast("array<string>")


def strip_html(html: Column, longer_than: int | None = 500) -> Column:
    """Tags to spaces, white space folded and trimmed, then named entities to spaces (which may leave double spaces). Null if not
    ``longer_than`` that many characters."""
    text = F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))
    text = F.regexp_replace(text, r"&[a-zA-Z]+;", " ")
    return text if longer_than is None else F.when(F.length(text) > longer_than, text)


def normalize_date(text: Column) -> Column:
    """The date as yyyy-MM-dd where one of five formats fits, else the trimmed text unchanged."""
    t = F.trim(text)
    parsed = [F.to_date(F.try_to_timestamp(t, F.lit(f))) for f in DATE_FORMATS]
    return F.coalesce(F.date_format(F.coalesce(*parsed), "yyyy-MM-dd"), t)


def in_dates(text: Column, start: str | None, end: str | None) -> Column:
    """Inclusive bounds on a yyyy-MM-dd text; what doesn't parse passes."""
    day = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    tests = [day >= F.lit(start).cast("date")] if start else []
    tests += [day <= F.lit(end).cast("date")] if end else []
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(True))


def quarter(title: Column) -> Column:
    q = F.regexp_extract(title, r"(?i)Q([1-4])", 1)
    return F.when(q != "", F.concat(F.lit("Q"), q)).otherwise("")


def year(title: Column) -> Column:
    return F.regexp_extract(title, r"(20\d{2})", 1)


def company_name(title: Column, ticker: Column) -> Column:
    """What stands before the ticker, less an opening bracket; the ticker if nothing does."""
    quoted = F.concat(F.lit(r"(?i)^(.+?)\s*[\(\[]?\Q"), ticker, F.lit(r"\E"))
    found = F.trim(F.call_function("regexp_extract", title, quoted, F.lit(1)))
    return F.when(found != "", found).otherwise(ticker)


def clean_text(text: Column) -> Column:
    """Characters mapped, boilerplate blanked, spaces folded, at most one blank line, no space before punctuation.
    Entities and compatibility characters are decoded before by ``decode_text`` where wanted."""
    t = F.translate(text, "".join(c for c, r in CHARACTERS.items() if r), "".join(r for r in CHARACTERS.values()))
    for c, r in CHARACTERS.items():
        if not r:
            t = F.replace(t, F.lit(c), F.lit(""))
    for pattern in BOILERPLATE:
        t = F.regexp_replace(t, pattern, " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"\s+([.,;:!?])", "$1")
    return F.coalesce(F.regexp_replace(t, r"^\s+|\s+$", ""), F.lit(""))


def decode_text(text: Column) -> Column:
    """Character references decoded, then NFKC. Spark has neither, so this is one Arrow function; use it only where needed."""
    import html
    import unicodedata

    import pandas as pd

    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize("NFKC", html.unescape(t)), na_action="ignore")

    decode.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "string")(text)


def sentences(text: Column) -> Column:
    """Pieces between white space that follows . ! or ? (what stands before is looked at behind white space only)."""
    return F.split(text, r"\s(?<=[.!?]\s)\s*", -1)


def contains_any(text: Column, values: Words) -> Column:
    return F.exists(words(values), lambda w: F.contains(text, w))


def forward_sentences(text: Column, cues: Words = d.FORWARD_CUES) -> Column:
    """Sentences that hold a cue anywhere (also inside words), joined by spaces."""
    return F.array_join(F.filter(sentences(text), lambda s: contains_any(F.lower(s), cues)), " ")


#: Words of any script, and each other character that isn't white space.
TOKEN = r"(?U)\w+|[^\w\s]"
#: Longer lists are looked up as a set, word by word; shorter ones by array functions.
SHORT = 12


def forms(text: Column, pattern: str = TOKEN) -> Column:
    """The lower-cased tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def member(word: Column, values: Words) -> Column:
    if isinstance(values, Column):
        return F.array_contains(values, word)
    return word.isin(list(values)) if values else F.lit(False)


def some_of(found: Column, values: Words) -> Column:
    """Whether one of the words is in the list."""
    if isinstance(values, Column) or len(values) <= SHORT:
        return F.coalesce(F.arrays_overlap(found, words(values)), F.lit(False))
    return F.coalesce(F.exists(found, lambda w: member(w, values)), F.lit(False))


def only(found: Column, values: Words, inside: bool = True) -> Column:
    """The different words that are (or aren't) in the list. The cost of a word doesn't grow with the list."""
    if isinstance(values, Column) or len(values) <= SHORT:
        return (F.array_intersect if inside else F.array_except)(found, words(values))
    return F.array_distinct(F.filter(found, lambda w: member(w, values) if inside else ~member(w, values)))


def terms(found: Column, lemma: Column | None = None, stop: Words = d.STOP_WORDS) -> Column:
    """The different lemmas (else forms) of the tokens whose form is no stop word."""
    if lemma is None:
        return only(found, stop, inside=False)
    return F.array_distinct(F.filter(lemma, lambda _, i: ~member(F.get(found, i), stop)))


def tokens(text: Column, stop: Words = d.STOP_WORDS, negation: Words = d.NEGATIONS, pattern: str = TOKEN, lemma: Column | None = None) -> Column:
    """array<struct<text, lemma, pos, is_stop, is_neg>>, the form in which sentences are exchanged; without ``lemma`` (an array as long as the
    tokens) a token's lemma is its lower-cased form."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda w, i: let(F.lower(w), lambda low: F.struct(
        w.alias("text"), (low if lemma is None else F.coalesce(F.get(lemma, i), low)).alias("lemma"), F.lit("").alias("pos"),
        member(low, stop).alias("is_stop"), member(low, negation).alias("is_neg"),
    )))


def has_negation(found: Column, negation: Words = d.NEGATIONS) -> Column:
    return some_of(found, negation)


def has_hedge(found: Column, lemma: Column | None = None, hedges: Words = d.HEDGES) -> Column:
    """A form or lemma in the list."""
    return some_of(found, hedges) if lemma is None else some_of(found, hedges) | some_of(lemma, hedges)


def mask_entities(text: Column) -> Column:
    """Amounts, shares, dates and numbers as placeholders, the rest in lower case."""
    t = F.lower(text)
    for pattern, mask in MASKS:
        t = F.regexp_replace(t, pattern, mask)
    return t


def lexicon_hits(term: Column, category: Words) -> Column:
    """Those of a sentence's ``terms`` that are in the list, sorted."""
    return F.sort_array(only(term, category))


def phrase_hits(low: Column, phrases: Words) -> Column:
    """Phrases that the lower-cased text contains, each once, sorted."""
    return F.sort_array(F.filter(words(phrases), lambda p: F.contains(low, p)))


def phrase_hits_plain(low: Column, phrases: list[str]) -> Column:
    """``phrase_hits`` of a short list without a lambda, so that code is generated for it."""
    none = F.array().cast("array<string>")
    found = [F.when(F.contains(low, F.lit(p)), words([p])).otherwise(none) for p in sorted(phrases)]
    return F.concat(none, *found)


def near_negation(found: Column, lemma: Column, hits: Column, window: int = 5, negation: Words = d.SCOPE_NEGATIONS) -> Column:
    """Whether a negation stands within ``window`` tokens of a token whose lemma is among ``hits``."""
    negates = lambda w, i: member(w, negation) | member(F.get(lemma, i), negation)
    start = lambda i: F.greatest(i - window, F.lit(0))
    around = lambda i: F.slice(lemma, start(i) + 1, i + window + 1 - start(i))
    at = F.filter(F.transform(found, lambda w, i: F.when(negates(w, i), i)), lambda i: i.isNotNull())
    return F.coalesce(F.exists(at, lambda i: F.arrays_overlap(around(i), hits)), F.lit(False))


def section_weight(section: Column, weights: dict[str, float] | None = None, prefixes: dict[str, float] | None = None) -> Column:
    weights = d.SECTION_WEIGHTS if weights is None else weights
    prefixes = d.SECTION_PREFIX_WEIGHTS if prefixes is None else prefixes
    out = F.lit(1.0)
    for prefix, w in prefixes.items():
        out = F.when(F.startswith(section, F.lit(prefix)), F.lit(w)).otherwise(out)
    for name, w in weights.items():
        out = F.when(section == name, F.lit(w)).otherwise(out)
    return out


def millionths(c: Column) -> Column:
    return F.round(c * 1_000_000).cast("long")


def ratio_of_millionths(total: Column, n: Column, places: int) -> Column:
    """total / n to so many digits, half away from zero; 0 if n is."""
    unit = 10 ** (6 - places)
    half_up = F.floor((2 * F.abs(total) + unit * n) / F.greatest(2 * unit * n, F.lit(1)))
    return F.signum(total.cast("double")) * half_up / float(10**places)


def exact_mean(c: str | Column, places: int = 4) -> Column:
    """The mean of an aggregate's group to so many digits, half away from zero, out of whole millionths: no order of adding decides
    a tie. Null without a value."""
    c = F.col(c) if isinstance(c, str) else c
    return ratio_of_millionths(F.sum(millionths(c)), F.count(c), places)


def net_label(net: Column, threshold: float | Column = 0.1) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(net > t, "positive").when(net < -t, "negative").otherwise("neutral")
