"""Pieces that several operators share: materialising, components and exact distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import buckets_for, free_name, ranked, unit_hash

__all__ = [
    "buckets_for", "clustered", "connected_components", "emptied", "free_name", "groups_of", "materialise", "ranked", "shared_dir",
    "shuffles_dropped", "unit_hash", "words_sql",
]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the session's checkpoint folder. On one
    machine without either a temporary one is made; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='filinglens-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later stages survive lost executors
    and never recompute what stands above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/filinglens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def emptied(*tables: DataFrame) -> None:
    """Give back the disk of tables that ``materialise`` or ``clustered`` wrote, once all that was read from them is written itself."""
    for table in tables:
        for folder in sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()}):
            table.sparkSession.range(0, 0, 1, 1).write.mode("overwrite").parquet(folder)


def clustered(df: DataFrame, *keys: str, deal: bool = False) -> DataFrame:
    """As ``materialise``, but bucketed by ``keys`` into as many buckets as shuffles have partitions: joins and aggregates by those
    keys don't shuffle the table again. Every task writes a file for each bucket of its rows: unless ``df`` is dealt by ``keys`` already,
    ``deal`` it, so that each bucket is one file."""
    spark = df.sparkSession
    name = f"filinglens_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if deal:
        df = df.repartition(buckets, *keys)
    writer = df.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd")
    writer.bucketBy(buckets, *keys).saveAsTable(name)
    return spark.table(name)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """For work whose steps read tables that earlier ones wrote. Inside, the shuffle files of a query go as soon as it has ended, in place of
    when the driver next collects its garbage, and small files of those tables are read many to a task: each task that shuffles opens a
    file for every partition."""
    inside = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.files.openCostInBytes": "262144"}
    before = {key: spark.conf.get(key, None) for key in inside}
    for key, value in inside.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node in it.

    Distributed union-find: each round takes the smallest label among neighbours, then jumps to the label
    that this one had itself, so labels travel ever farther. Each round is one written table.
    """
    sym = (
        edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("x IS NOT NULL AND y IS NOT NULL")
        .distinct()
    )
    sym = materialise(sym)
    labels = materialise(sym.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    for _ in range(max_rounds):
        low = (
            sym.join(labels.select(F.col("node").alias("y"), F.col("component").alias("m")), "y")
            .groupBy("x")
            .agg(F.min("m").alias("m"))
        )
        near = labels.join(low, labels.node == low.x, "left").select(
            "node", F.col("component").alias("old"), F.least("component", "m").alias("c")
        )
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("jump"))
        jumped = materialise(near.join(up, near.c == up.up, "left").select("node", "old", F.least("c", "jump").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("component < old").isEmpty():
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return labels


def groups_of(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups out of the batches of a partition that is sorted by ``keys``."""
    held: list[pd.DataFrame] = []
    last: tuple | None = None
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys]
        cut = (k != k.shift()).any(axis=1).to_numpy().nonzero()[0]
        cut = [*cut.tolist(), len(pdf)]
        if cut[0] != 0:
            cut = [0, *cut]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            piece = pdf.iloc[i:j]
            key = tuple(piece.iloc[0][keys])
            if held and key != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(piece)
            last = key
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def words_sql(text: Column) -> Column:
    """The number of runs of characters other than space, tab and line ends; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0))

