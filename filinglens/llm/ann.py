"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import groups_of, materialise

TREES = 48
#: Bits of a hash string; prefixes of it are what trees branch on.
BITS = 62
#: A query descends to the longest common prefix that so many vectors hold at least; this grows until recall is met.
LEAF = 800
TARGET_RECALL = 0.92
SAMPLE_QUERIES = 64
#: From a subtree over this many times LEAF a query goes one bit further; blocks of a subtree in the search have so many vectors at most.
CROWDED = 4
#: Prefixes are counted so many bits beyond the length at which subtrees have about LEAF vectors.
STEP = 4


def clean_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(id, v): vectors as doubles; null, empty, zero, or holding null or non-finite components take no part, nor do null ids.
    Of rows that share an id the least vector counts."""
    v = F.col(embedding).cast("array<double>")
    df = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.where(fine).groupBy("id").agg(F.min("v").alias("v"))


def _planes(trees: int, bits: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, trees, bits, dim]).standard_normal((dim, trees * bits)).astype(np.float32)


def _hasher(trees: int, bits: int, seed: int):
    """The hash string of a vector in every tree, as the integer whose binary digits it is."""

    def hashes(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
        planes: dict[int, np.ndarray] = {}
        weight = np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for vs in batches:
            out = []
            for v in vs:
                x = np.asarray(v, dtype=np.float64)
                p = planes.setdefault(len(x), _planes(trees, bits, len(x), seed)) if len(x) not in planes else planes[len(x)]
                sign = (x / np.abs(x).max()).astype(np.float32) @ p > 0
                out.append(sign.reshape(trees, bits) @ weight)
            yield pd.Series(out)

    hashes.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return hashes


def _search(k: int):
    """Exact cosines inside one subtree (or a block of it): the best ``k`` of each query there."""

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[pd.DataFrame] = []
        held = 0
        for g in groups_of(batches, ["tree", "depth", "prefix", "block"]):
            q, c = g[g["is_query"]], g[~g["is_query"]]
            if not len(q) or not len(c):
                continue
            for dim in {len(v) for v in q["v"]}:
                found = best(q[[len(v) == dim for v in q["v"]]], c[[len(v) == dim for v in c["v"]]], k)
                if found is not None:
                    out.append(found)
                    held += len(found)
            if held > 50_000:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return search


def unit_rows(vs) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vs])
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best(q: pd.DataFrame, c: pd.DataFrame, k: int) -> pd.DataFrame | None:
    if not len(c) or not len(q):
        return None
    cid, cu = c["id"].to_numpy(), unit_rows(c["v"])
    qids, ids, scores = [], [], []
    for lo in range(0, len(q), 256):
        part = q.iloc[lo : lo + 256]
        sim = unit_rows(part["v"]) @ cu.T
        for qid, row in zip(part["id"].to_numpy(), sim, strict=True):
            other = cid != qid
            x, i = row[other], cid[other]
            if len(x) > k:
                least = np.partition(x, -k)[-k]
                near = x >= least - 1e-6  # what rounding may have put behind the last
                x, i = x[near], i[near]
            order = np.lexsort((i, -x))
            qids += [qid] * len(order)
            ids += i[order].tolist()
            scores += x[order].tolist()
    return pd.DataFrame({"query_id": qids, "id": ids, "score": scores})


def exact_score(a: Column, b: Column) -> Column:
    """The cosine of two original vectors in double precision, summed from the left."""
    a, b = _scaled(a), _scaled(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return dot / (norm(a) * norm(b))


def _scaled(v: Column) -> Column:
    """The vector, divided by its greatest component where squares would overflow or vanish; the cosine is the same."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(top.between(1e-140, 1e140), v).otherwise(F.transform(v, lambda x: x / top))


def _prefix(hash_: str, depth: Column, bits: int) -> Column:
    return F.call_function("shiftrightunsigned", F.col(hash_), F.lit(bits) - depth)


def _subtrees(rows: DataFrame, n: int, leaf: int, bits: int) -> DataFrame:
    """(tree, depth, prefix, n): every common prefix of the sorted hash strings that at least ``leaf`` vectors hold, and the roots.

    Strings are counted by prefixes of one length, which sum up to those of all shorter lengths; what still holds ``leaf``
    vectors there is counted again by longer ones. So few jobs give every length, and no task sorts a whole tree.
    """
    depth = min(bits, max(0, int(np.log2(max(n, 1) / leaf))) + STEP)
    low, parts = 0, []
    while True:
        cells = rows.groupBy("tree", _prefix("hash", F.lit(depth), bits).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        ups = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth))))
        ups = ups.withColumn("prefix", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(depth) - F.col("depth")))
        counted = ups.groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("n"))
        parts.append(materialise(counted.where((F.col("n") >= leaf) | (F.col("depth") == 0))))
        full = parts[-1].where(F.col("depth") == depth)
        if depth == bits or full.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        rows = rows.withColumn("prefix", _prefix("hash", F.lit(depth), bits)).join(full.select("tree", "prefix"), ["tree", "prefix"], "left_semi").drop("prefix")
        low, depth = depth + 1, min(bits, depth + 2 * STEP)


def _lengths(df: DataFrame) -> list[int]:
    """The different prefix lengths of a table, BITS + 1 of them at most."""
    return sorted(r.depth for r in df.select("depth").distinct().collect())


def _descend(rows: DataFrame, subtrees: DataFrame, leaf: int, bits: int) -> DataFrame:
    """(id, tree, hash, depth, crowded): how long a prefix each query follows in each tree: the longest that ``leaf`` vectors hold, or one bit
    more where over CROWDED times as many do (at all bits there is none: those subtrees are searched in blocks)."""
    # a column's name of its own tells the queries' lengths, in a plan, from those of all rows in _search_at
    at = rows.withColumn("length", F.explode(F.array(*[F.lit(x) for x in _lengths(subtrees)])))
    at = at.withColumn("prefix", _prefix("hash", F.col("length"), bits)).withColumnRenamed("length", "depth").join(subtrees, ["tree", "depth", "prefix"])
    last = at.groupBy("id", "tree", "hash").agg(F.max(F.struct("depth", "n")).alias("x"))
    crowded = F.col("x.n") > CROWDED * leaf
    return last.select("id", "tree", "hash", F.least(F.col("x.depth") + crowded.cast("int"), F.lit(bits)).alias("depth"), crowded.alias("crowded"))


def _search_at(rays: DataFrame, rows: DataFrame, asks: DataFrame, k: int, leaf: int, bits: int) -> DataFrame:
    """(query_id, id, score): the ``k`` nearest of each query in each of its subtrees; ``asks`` says how long its prefixes are."""
    cells = ["tree", "depth", "prefix"]
    asks = asks.withColumn("prefix", _prefix("hash", F.col("depth"), bits)).select("id", *cells)
    at = rows.withColumn("depth", F.explode(F.array(*[F.lit(x) for x in _lengths(asks)])))
    at = at.withColumn("prefix", _prefix("hash", F.col("depth"), bits)).drop("hash")
    data = materialise(at.join(asks.select(cells).distinct(), cells, "left_semi"))
    sizes = data.groupBy(cells).agg(F.ceil(F.count(F.lit(1)) / (CROWDED * leaf)).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    data = data.join(sizes, cells, "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("is_query", F.lit(False))
    asks = asks.join(sizes, cells, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("is_query", F.lit(True))
    both = data.unionByName(asks).drop("blocks").join(rays, "id").repartition(*cells, "block").sortWithinPartitions(*cells, "block")
    return both.mapInPandas(_search(k), "query_id long, id long, score double")


def _forest_search(
    rays: DataFrame, hashed: DataFrame, queries: DataFrame, sizes: dict[int, int], k: int, leaf: int, bits: int, trees: int
) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score) found, and the (id) of queries that met a crowded subtree."""
    tree = (F.col("dim") * trees + F.col("pos")).alias("tree")  # vectors of each dimension have trees of their own
    rows = hashed.select("id", "dim", F.posexplode("hashes").alias("pos", "hash")).select("id", tree, "hash")
    subtrees = _subtrees(rows, max(sizes.values(), default=0), leaf, bits)
    asks = materialise(_descend(rows.join(queries, "id", "left_semi"), subtrees, leaf, bits))
    crowded = asks.where("crowded").select("id").distinct()
    found = materialise(_search_at(rays, rows, asks, k, leaf, bits).groupBy("query_id", "id").agg(F.max("score").alias("score")))
    enough = queries.join(hashed.select("id", "dim"), "id").select("id", F.least(F.lit(k), sizes_of(sizes) - 1).alias("enough"))
    while True:
        have = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("have"))
        lacking = enough.join(have, "id", "left").where(F.coalesce("have", F.lit(0)) < F.col("enough")).select("id")
        asks = materialise(asks.join(lacking, "id", "left_semi").withColumn("depth", F.greatest(F.col("depth") - 1, F.lit(0))))
        if asks.isEmpty():
            return found, crowded
        more = _search_at(rays, rows, asks, k, leaf, bits)
        found = materialise(found.unionByName(more).groupBy("query_id", "id").agg(F.max("score").alias("score")))


def sizes_of(sizes: dict[int, int]) -> Column:
    """The number of vectors of a row's dimension."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col("dim"))


def neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, bits: int = BITS, leaf: int = LEAF,
    target_recall: float = TARGET_RECALL, seed: int = 5, key: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by cosine found for each query (rows of ``vectors`` by id).

    Index: in each tree a vector's hash string is the signs of ``bits`` random projections; a sorted array of them
    is dealt over the cluster by its prefixes. Query: in every tree the query descends bit by bit to the longest prefix of its own
    string that ``leaf`` vectors hold (see _descend), and all vectors there are candidates, compared exactly on the original vectors.
    Queries with fewer than ``k`` different candidates ascend by one bit in all trees at once until they have them.
    Recall is measured by brute force on a bounded sample of all queries and on one of those that met a crowded subtree; while
    either is under ``target_recall`` subtrees double and the search runs again, at last over everything.

    Vectors of equal hash strings are never dropped: their subtrees are split into blocks. Equal
    vectors are searched once: a class stands for all of its rows, of which the k + 1 of smallest id can be among
    results. Unfit vectors (see clean_vectors) take no part; a query without candidates has no rows; ranks run from 1;
    ties go to the smaller vec_id; only vectors of the same dimension are compared.
    """
    clean = materialise(clean_vectors(vectors, key, embedding))
    asked = queries.select(F.col(key).cast("long").alias("id")).distinct()
    few = W.partitionBy("v").orderBy("id")
    # equal vectors: one class; salted first so that a vector that a third of the rows hold meets no single window
    salted = W.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    heads = clean.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    heads = heads.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1)
    classes = materialise(heads.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    query_rows = clean.join(asked, "id").withColumnRenamed("id", "query_id")
    query_classes = query_rows.join(classes.select("v", "id"), "v").select("query_id", "id")
    query_classes = materialise(query_classes)
    reps = classes.select("id", "v")
    sizes = {r.dim: r.n for r in reps.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    hashes = F.pandas_udf(_hasher(trees, bits, seed), "array<long>")
    hashed = materialise(reps.select("id", F.size("v").alias("dim"), hashes("v").alias("hashes")))
    wanted = query_classes.select("id").distinct()
    # only directions travel, as floats; final scores are computed from the original vectors
    top = F.aggregate("v", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    rays = materialise(reps.withColumn("top", top).select("id", F.transform("v", lambda x: (x / F.col("top")).cast("float")).alias("v")))
    while True:
        found, crowded = _forest_search(rays, hashed, wanted, sizes, k, leaf, bits, trees)
        if leaf >= max(sizes.values(), default=0) or min(_recall(reps, some, found, k) for some in (wanted, crowded)) >= target_recall:
            break
        leaf *= 2
    # back from classes to rows: a class's own members are its nearest neighbours, then those of the classes found
    pairs = query_classes.join(found.select(F.col("query_id").alias("id"), F.col("id").alias("other")), "id")
    pairs = pairs.select("query_id", "other").unionByName(query_classes.select("query_id", F.col("id").alias("other"))).distinct()
    out = pairs.join(classes.select(F.col("id").alias("other"), F.col("v").alias("w"), "ids"), "other")
    out = out.join(query_rows, "query_id").withColumn("score", exact_score(F.col("v"), F.col("w")))
    out = out.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _recall(reps: DataFrame, wanted: DataFrame, found: DataFrame, k: int) -> float:
    """The share of true nearest classes found, over SAMPLE_QUERIES queries chosen by hash, against all vectors."""
    sample = wanted.orderBy(F.xxhash64("id")).limit(SAMPLE_QUERIES)
    qs = [(r.id, list(r.v)) for r in reps.join(sample, "id").collect()]
    if not qs:
        return 1.0
    q = pd.DataFrame(qs, columns=["id", "v"])

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in batches:
            for dim in {len(v) for v in q["v"]}:
                r = best(q[[len(v) == dim for v in q["v"]]], c[[len(v) == dim for v in c["v"]]], k)
                if r is not None:
                    yield r

    true = reps.mapInPandas(scan, "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    true = true.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "id")
    got = true.join(found.select("query_id", "id"), ["query_id", "id"], "left_semi").count()
    return got / max(1, true.count())

