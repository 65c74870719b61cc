"""Exact length histogram of encoded documents, and every context limit's totals from it."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Fixed value: the pre-tokenisation pattern that the byte-level vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space, as that pattern means it, from this length on are cut out before it is applied: it keeps a way back for every
#: character of a run, which exhausts its stack. A run is one piece but for its last character, so the count stays exact.
LONG_RUN = 4096
_LONG = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoding(vocabulary: str):
    """The byte-level BPE of a rank file ("base64 rank" a line); one instance a worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(enc, text: str | None) -> int:
    """The number of tokens of a text; none for null and empty ones."""
    if not text:
        return 0
    n, at = 0, 0
    for run in _LONG.finditer(text):
        end = run.end() - (run.end() < len(text))  # the last character goes to what follows
        n += len(enc.encode_ordinary(text[at : run.start()])) + len(enc._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(enc.encode_ordinary(text[at:]))


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (null: 0). ``vocabulary`` is a path that every worker has."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for texts in batches:
            yield pd.Series([token_count(enc, t) for t in texts], dtype="int64")

    return docs.withColumn(out, F.pandas_udf(count, "long")(F.col(text)))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length. One row a length, never one a document."""
    lengths = encoded_lengths(docs.select(text), vocabulary, text, "n_tokens")
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame, width: int = 1024) -> DataFrame:
    """For every length L of the histogram taken as context limit, from prefix and suffix sums:

    ``docs_upto`` (documents of at most L tokens), ``docs_over``, ``tokens_upto`` (tokens of the former),
    ``truncated_total`` (sum of min(length, L): what is left if every document is cut to L),
    ``lost_tokens`` and ``quantile`` (share of documents of at most L tokens). A limit between two
    lengths follows from the row below it: truncated_total + docs_over * (limit - L).

    Sums run in two steps, over ranges of ``width`` lengths and then inside each, so no task gets all lengths. Empty
    input gives no rows; null texts count as length 0; a repeated length is added up first.
    """
    h = histogram.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = h.withColumn("_range", F.floor(F.col("n_tokens") / width))
    sums = h.groupBy("_range").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    ahead = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    sums = sums.select(
        "_range",
        F.coalesce(F.sum("d").over(ahead), F.lit(0)).alias("_d"),
        F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("_t"),
        F.sum("d").over(every).alias("_docs"),
        F.sum("t").over(every).alias("_tokens"),
    )
    upto = W.partitionBy("_range").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    h = h.withColumn("docs_upto", F.sum("n_docs").over(upto)).withColumn(
        "tokens_upto", F.sum(F.col("n_docs") * F.col("n_tokens")).over(upto)
    )
    h = h.join(sums, "_range")
    h = h.withColumn("docs_upto", F.col("docs_upto") + F.col("_d")).withColumn("tokens_upto", F.col("tokens_upto") + F.col("_t"))
    h = h.withColumn("docs_over", F.col("_docs") - F.col("docs_upto"))
    kept = F.col("tokens_upto") + F.col("docs_over") * F.col("n_tokens")
    return h.select(
        "n_tokens", "n_docs", "docs_upto", "docs_over", "tokens_upto",
        kept.alias("truncated_total"),
        (F.col("_tokens") - kept).alias("lost_tokens"),
        (F.col("docs_upto") / F.col("_docs")).alias("quantile"),
    )
