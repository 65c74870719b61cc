"""Fill-in-middle transformation: texts cut between their units and put together anew around the missing middle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a line with its end, or the rest of a text behind the last end.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def _cut_offsets(unit: str):
    """An Arrow function (text, h1, h2) -> (n units, offset of the smaller cut, offset of the larger one), in code points."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        # possessive: what a unit took is never given back, so that no way back is kept for any of its characters
        whole = regex.compile(f"((?>{unit}))*+")
        for texts, h1, h2 in batches:
            rows = []
            for text, a, b in zip(texts, h1.tolist(), h2.tolist(), strict=True):
                found = whole.fullmatch(text)
                if found is None:
                    raise ValueError(f"the unit {unit!r} doesn't cover every text")
                ends = found.ends(1)
                n = len(ends)
                low, high = sorted((a % (n + 1), b % (n + 1)))
                rows.append((n, ends[low - 1] if low else 0, ends[high - 1] if high else 0))
            yield pd.DataFrame(rows, columns=["n", "a", "b"], dtype="int64")

    return F.pandas_udf(cut, "n long, a long, b long")


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = LINE, seed: int = 7, percent: int = 100, spm_percent: int = 50,
) -> DataFrame:
    """``docs`` with ``n`` (units of the text), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    One fullmatch of ``(unit)*`` keeps the end of every repetition: their number is n, and the ends picked by the key's hash are
    both cuts. Only three numbers come back from it; what they cut is put together by Spark's own string functions.
    ``percent`` of the keys are transformed, ``spm_percent`` of these suffix first. ``restore`` gives the text again.

    Defined cases: a null text is empty; an empty one, or one that holds a mark, is ``plain`` (the output is the text, the
    lengths of its parts null); a null key is hashed as an empty one; repeated rows each get the same output; no rows
    give none; columns that have an added name are replaced. Units must cover any text, as lines do.
    """
    keep = [c for c in docs.columns if c not in ADDED or c in (key, text)]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    whole = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.struct(*keep).alias("row"), whole.alias("t"), F.array(*h).alias("h"))
    cut = cut.withColumn("cut", _cut_offsets(unit)(F.col("t"), F.col("h")[0], F.col("h")[1]))
    t, a, b = F.col("t"), F.col("cut.a"), F.col("cut.b")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (F.col("h")[2] % 100 >= percent)
    form = F.when(plain, "plain").when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm")
    part = lambda start, end: F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b), part(b, F.lit(2**31 - 1) + F.lit(0) * b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = cut.withColumn("form", form)
    is_plain = F.col("form") == "plain"
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("cut.n").alias("n"), "form",
        F.when(~is_plain, a).alias("prefix_chars"), F.when(~is_plain, b - a).alias("middle_chars"),
        F.when(is_plain, t).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"),
    )


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Transformed texts hold no marks of their own, so the first of each kind is the one put in."""
    at = lambda mark: F.locate(mark, output)
    between = lambda start, end: F.substring(output, start + 3, end - start - 3)
    p, s, m, end = at(PREFIX), at(SUFFIX), at(MIDDLE), F.length(output) + 1
    prefix = F.when(form == "psm", between(p, s)).otherwise(between(p, m))
    suffix = F.when(form == "psm", between(s, m)).otherwise(between(s, p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(m, end), suffix))
