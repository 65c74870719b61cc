"""Exact ranks and running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores until no column of ``df`` is called so (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


#: Rows that one window of ``ranked`` takes, about.
BUCKET_ROWS = 8_000


def buckets_for(df: DataFrame) -> int:
    """How many ranges to deal the rows of ``df`` over: as many more as there are more rows."""
    return max(64, -(-df.count() // BUCKET_ROWS))


def ranked(
    df: DataFrame, groups: list[Column], spread: Column, order: list[Column], rank: str, rows: str | None = None,
    size: Column | None = None, running: str | None = None, buckets: int = 64,
) -> DataFrame:
    """Add the 0-based ``rank`` of every row within its group, the number of ``rows`` of that group and,
    with ``size``, the ``running`` sum of the sizes before the row.

    ``spread`` is a value in [0, 1) that the order begins with: rows are dealt over ``buckets`` equal
    ranges of it, numbered inside a range by a window, and offset by the totals of the ranges before. So
    no window holds a whole group, however large. The totals (groups x buckets rows) are joined on the
    window's own keys, so the rows are shuffled once. Null groups form a group.
    """
    names = [free_name(df, f"_g{i}") for i in range(len(groups))]
    bucket, first, count, all_, amount, before = (
        free_name(df, n) for n in ("_bucket", "_first", "_count", "_all", "_amount", "_before")
    )
    for name, col in zip(names, groups, strict=True):
        df = df.withColumn(name, F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("")))
    df = df.withColumn(bucket, F.least(F.lit(buckets - 1), F.floor(spread * buckets)).cast("int"))
    part = W.partitionBy(*names, bucket)
    sums = [F.count(F.lit(1)).alias(count)] + ([F.sum(size).alias(amount)] if running else [])
    ahead = W.partitionBy(*names).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*names, bucket).agg(*sums)
    totals = totals.select(
        *names, bucket, F.coalesce(F.sum(count).over(ahead), F.lit(0)).alias(first),
        F.sum(count).over(W.partitionBy(*names)).alias(all_),
        *([F.coalesce(F.sum(amount).over(ahead), F.lit(0)).alias(before)] if running else []),
    )
    out = df.withColumn(rank, F.row_number().over(part.orderBy(*order)) - 1)
    if running:
        inside = part.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn(running, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    out = out.join(totals, [*names, bucket]).withColumn(rank, F.col(rank) + F.col(first))
    if running:
        out = out.withColumn(running, F.col(running) + F.col(before))
    if rows:
        out = out.withColumn(rows, F.col(all_))
    return out.drop(*names, bucket, first, all_, before)


def unit_hash(*cols: Column) -> Column:
    """A value in [0, 1) from md5 of the parts joined by '|' (52 bits, so exact as a double in any engine)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
