"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import buckets_for, free_name, ranked, unit_hash

SEED = "shard-1"


def interleave(
    docs: DataFrame, shards: int = 8, stratum: str = "source", key: str = "doc_id", text: str = "text",
    seed: str = SEED, buckets: int | None = None,
) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long) to every row; nothing else changes.

    Rows of each stratum are shuffled by a seeded hash and get the fraction (rank + 1/2) / rows of the stratum.
    Sorting all rows by fraction interleaves the strata in proportion; cutting that order into ``shards``
    equal runs gives shards whose row counts differ by at most one and whose mixture is the corpus's.
    The law is ``rows``: neither bytes nor equal texts are balanced or kept together.

    Defined cases: a null stratum is a stratum of its own; null keys and repeated rows are ranked like any
    other (ties fall to key, then text; full copies are interchangeable); no rows give no rows; fewer rows than shards
    leave shards empty. Columns called ``shard`` or ``slot`` are replaced.
    """
    docs = docs.drop("shard", "slot")
    buckets = buckets or buckets_for(docs)
    u, r, n, f, pos, total = (free_name(docs, x) for x in ("_u", "_r", "_n", "_f", "_pos", "_total"))
    name = F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    df = docs.withColumn(u, unit_hash(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    df = ranked(df, [F.col(stratum)], F.col(u), [F.col(u), F.col(key), F.col(text)], r, rows=n, buckets=buckets)
    df = df.withColumn(f, (F.col(r) * 2 + 1).cast("double") / (F.col(n) * 2).cast("double"))
    df = ranked(df, [], F.col(f), [F.col(f), name, F.col(key), F.col(r)], pos, rows=total, buckets=buckets)
    df = df.withColumn("shard", F.expr(f"({pos} * {shards}) div {total}").cast("int"))
    df = df.withColumn("slot", F.expr(f"{pos} - (shard * {total} + {shards - 1}) div {shards}"))
    return df.select(*docs.columns, "shard", "slot")
