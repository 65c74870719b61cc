"""Fuzzy line deduplication by MinHash, with DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .base import clustered, connected_components, emptied, materialise, shuffles_dropped

#: Characters of a shingle, and the similarity from which lines are one.
SHINGLE = 5
THRESHOLD = 0.8
#: A signature has BANDS * ROWS bins; lines that agree in all bins of a band are candidates.
BANDS = 10
ROWS = 4
#: Points of a line that its bins are filled from, about. Three a bin leave few bins empty.
POINTS = 120
#: A line whose shingles fill fewer bins repeats itself; it is signed again by the number of its distinct shingles. Others have at
#: least DISTINCT of their shingles once only.
FILLED = 34
DISTINCT = 0.5
#: Words of 64 bits in the sketch of a line; the bits on which its points fall are set.
WORDS = 5
#: Words of 64 bits (a power of two) in the bitmap of all shingles of a line that is in a candidate pair, and from how many pairs a line
#: on bitmaps cost less than checking all pairs.
FINE = 32
MANY = 2
#: What travels with a row of a bucket.
SKETCH = ["copies", "n", *(f"x{w}" for w in range(WORDS))]
#: Lines of a bucket up to which all meet all at once; most buckets have two or three lines, which share a band by chance.
SMALL = 8
#: Rows of a bucket that meet in one group of the join; larger buckets are dealt over several.
SLICE = 1024


def normalised(line: Column) -> Column:
    """Lower-cased, white space runs as one space, trimmed. Most lines have single spaces alone, which a byte search tells."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\f\x0b":
        odd = odd | F.contains(line, F.lit(c))
    return F.trim(F.lower(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line)))


def shingles(norm: Column) -> Column:
    """The distinct runs of SHINGLE characters (the whole line, if shorter)."""
    return F.when(F.length(norm) <= SHINGLE, F.array(norm)).otherwise(
        F.array_distinct(F.regexp_extract_all(norm, F.lit(rf"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1)))
    )


def _codes(norm: str) -> Column:
    """A line at four bytes a character, so that no position is searched for."""
    return F.encode(F.make_valid_utf8(norm), "UTF-32")


def _starts(code: Column) -> Column:
    """The places in ``_codes`` where shingles begin."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(code) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))


def _hashes(norm: str) -> Column:
    """The 64-bit hashes of the distinct shingles of a line. Its codes are a lambda's variable: a column of bytes would be copied whole for
    every shingle."""
    return F.array_distinct(let(_codes(norm), lambda code: F.transform(_starts(code), lambda at: F.xxhash64(F.substring(code, at, F.lit(4 * SHINGLE))))))


def line_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, norm, k1, k2) of every line that isn't blank: its normal form and the two halves of that one's 128-bit hash."""
    lines = docs.select(F.col(key).cast("long").alias("id"), F.posexplode(F.split(F.col(text).cast("string"), "\n", -1)).alias("line_no", "line"))
    # exploding one array keeps the optimiser from computing the normal form anew for every use
    lines = lines.select("id", "line_no", F.explode(F.array(normalised(F.col("line")))).alias("norm")).where("norm <> ''")
    return lines.select("id", "line_no", "norm", F.xxhash64("norm").alias("k1"), F.xxhash64(F.lit("second"), "norm").alias("k2"))


def _positions(texts: DataFrame) -> DataFrame:
    """(k1, k2, copies, n, turn, shingle) for every position of every line and every turn that can throw a point below its limit."""
    n = F.greatest(F.length("norm") - (SHINGLE - 1), F.lit(1))
    rows = texts.select("k1", "k2", "copies", n.alias("n"), F.explode(F.array(_codes("norm"))).alias("code"))
    rows = rows.withColumn("turn", F.explode(_turns()))
    rows = rows.withColumn("at", F.explode(_starts(F.col("code"))))
    return rows.select("k1", "k2", "copies", "n", "turn", F.substring("code", F.col("at"), F.lit(4 * SHINGLE)).alias("shingle"))


def _distinct(texts: DataFrame) -> DataFrame:
    """As ``_positions``, for every distinct shingle."""
    rows = texts.select("k1", "k2", "copies", F.explode(F.array(shingles(F.make_valid_utf8("norm")))).alias("shingles"))
    rows = rows.withColumn("n", F.size("shingles")).withColumn("turn", F.explode(_turns()))
    rows = rows.select("k1", "k2", "copies", "n", "turn", F.explode("shingles").alias("shingle"))
    return rows.withColumn("shingle", F.encode("shingle", "UTF-32"))


def _turns() -> Column:
    return F.sequence(F.lit(0), F.greatest(F.ceil(POINTS / F.col("n")).cast("int") - 1, F.lit(0)))


def _signatures(rows: DataFrame) -> DataFrame:
    """(k1, k2, copies, n, filled, x0, x1, ..., b0, b1, ...): the bins that each line fills, its sketch and its band keys (null: an empty band).

    Every shingle throws points: the first by its hash in [0, 1), the next in [1, 2) and so on, each into a bin. A line takes the
    points below POINTS / ``n``, so that long and short ones fill their bins alike, and a bin keeps its least point: the part of
    equal bins estimates the Jaccard similarity. The limit only cuts off what is great, which seldom is the least of a bin.

    The rows come from generated loops over a table that is clustered by its key, so all of this is one stage.
    """
    rows = rows.select("k1", "k2", "copies", "n", "turn", F.xxhash64("turn", "shingle").alias("h"))
    point = F.col("turn") * F.lit(1 << 44) + F.shiftrightunsigned("h", 20)
    rows = rows.select("k1", "k2", "copies", "n", F.col("h").bitwiseAND(F.lit((1 << 20) - 1)).alias("bin"), point.alias("point"))
    rows = rows.where(F.col("point").cast("double") * F.col("n") < F.lit(POINTS * float(1 << 44)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("point").bitwiseAND(F.lit(63)).cast("int"))
    rows = rows.select("k1", "k2", "copies", "n", "point", bit.alias("bit"), (F.col("bin") % BANDS).alias("band"), (F.shiftright("bin", 10) % ROWS).alias("row"))
    least = [f"m{i}" for i in range(ROWS)]
    bands = rows.groupBy("k1", "k2", "copies", "n", "band").agg(
        *[F.min(F.when(F.col("row") == i, F.col("point"))).alias(m) for i, m in enumerate(least)], F.bit_or("bit").alias("word")
    )
    full = reduce(Column.__add__, [F.col(m).isNotNull().cast("int") for m in least])
    bucket = F.xxhash64("band", *[F.coalesce(m, F.lit(-1)) for m in least])
    bands = bands.select("k1", "k2", "copies", "n", "band", "word", full.alias("full"), bucket.alias("bucket"))
    return bands.groupBy("k1", "k2", "copies", "n").agg(
        F.sum("full").alias("filled"),
        *[F.coalesce(F.bit_or(F.when(F.col("band") % WORDS == w, F.col("word"))), F.lit(0)).alias(f"x{w}") for w in range(WORDS)],
        *[F.max(F.when(F.col("band") == b, F.col("bucket"))).alias(f"b{b}") for b in range(BANDS)],
    )


def _nodes(texts: DataFrame) -> DataFrame:
    """(node, k1, k2, copies, n, x0, ..., b0, ...): a number for every distinct line, and its signature."""
    strong = materialise(_signatures(_positions(texts)).select(F.monotonically_increasing_id().alias("node"), "*")).where(F.col("filled") >= FILLED)
    weak = texts.join(strong.select("k1", "k2").hint("shuffle_hash"), ["k1", "k2"], "left_anti")
    again = _signatures(_distinct(weak))
    return strong.unionByName(materialise(again.select((-1 - F.monotonically_increasing_id()).alias("node"), "*"))).drop("filled")


def _alike(x: str, y: str, threshold: float) -> Column:
    """Whether the sketches of two rows allow the similarity ``threshold``.

    Of two lines of that similarity, (1 - t) / (1 + t) of the points of both are in one only, and the shorter one's limit lets in
    more points by the ratio of the lengths. Four deviations of the sampling are added (whole turns aren't sampled). Some of those
    points share a bit with each other or with a common point, as is to be expected of at least t * DISTINCT of them.
    """
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{x}.x{w}").bitwiseXOR(F.col(f"{y}.x{w}"))) for w in range(WORDS)])
    least, most = F.least(F.col(f"{x}.n"), F.col(f"{y}.n")), F.greatest(F.col(f"{x}.n"), F.col(f"{y}.n"))
    extra = POINTS * (1 - least / most)
    single = POINTS * ((1 - threshold) / (1 + threshold) * (1 + least / most))
    turns = POINTS / most
    part = turns - F.floor(turns)
    single = single + extra + 4 * F.sqrt(single * part * (1 - part) / turns + extra)
    bits = 64 * WORDS
    limit = bits * math.exp(-threshold * DISTINCT * POINTS / bits) * (1 - F.exp(-single / bits))
    return (least >= threshold * DISTINCT * most) & (differ <= limit)


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, size, node, copies, n, x0, ...): the lines of every band key that more than one line has, clustered by it."""
    rows = nodes.select("node", F.explode(F.array(*[f"b{b}" for b in range(BANDS)])).alias("bucket")).where("bucket IS NOT NULL")
    # one shuffle and one sort: a join with the buckets' counts would move and sort all of these rows again
    rows = rows.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("bucket")).cast("int")).where("size > 1")
    rows = materialise(rows)  # its shuffle, the widest of all, goes before sketches are joined
    found = clustered(rows.join(nodes.select("node", *SKETCH), "node"), "bucket", deal=True)
    emptied(rows)
    return found


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): all pairs of lines of a bucket whose sketches allow the similarity."""
    x, y = rows.alias("x"), rows.alias("y").hint("shuffle_hash")
    met = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & _alike("x", "y", threshold))
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _stars(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): every line of a bucket with the bucket's most frequent one (then the one of the least number), if their sketches allow it.
    So few pairs join most of a large group of copies: what is copied most is in the middle of its variants."""
    heads = rows.groupBy("bucket").agg(F.max(F.struct("copies", (-F.col("node")).alias("last"), *SKETCH[1:])).alias("y"))
    met = rows.alias("x").join(heads, "bucket").where((F.col("x.node") != -F.col("y.last")) & _alike("x", "y", threshold))
    a, b = F.col("x.node"), -F.col("y.last")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def _apart(rows: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ca, cb): the pairs of lines of a bucket that are alike by their sketches, but that ``labels`` (node, component) leave in
    two components.

    The lines outside the largest component of a bucket meet all of its lines, dealt over slices so that no group of the join
    holds all of a large bucket. Nothing is capped.
    """
    rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    parts = parts.groupBy("bucket").agg(
        F.sum("k").alias("size"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("k", "component")).alias("major")
    )
    rows = rows.join(parts.where("parts > 1").drop("parts"), "bucket")
    rows = rows.withColumn("slices", F.ceil(F.col("size") / SLICE).cast("int"))
    minor = rows.where("component <> major").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    every = rows.withColumn("slice", F.pmod(F.xxhash64("node"), "slices").cast("int"))
    x, y = minor.alias("x"), every.alias("y")
    once = (F.col("y.component") == F.col("y.major")) | (F.col("x.node") < F.col("y.node"))
    on = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.slice") == F.col("y.slice")) & (F.col("x.component") != F.col("y.component"))
    return x.join(y, on & once & _alike("x", "y", threshold)).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.component").alias("ca"), F.col("y.component").alias("cb"),
    ).dropDuplicates(["a", "b"])


def _bitmaps(lines: DataFrame) -> DataFrame:
    """(node, n, y0, ...) for every row of ``lines`` (node, norm): the number of its positions, and the bits on which its shingles fall."""
    rows = lines.select("node", F.explode(F.array(_codes("norm"))).alias("code"))
    rows = rows.withColumn("at", F.explode(_starts(F.col("code"))))
    rows = rows.select("node", F.xxhash64(F.substring("code", F.col("at"), F.lit(4 * SHINGLE))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    rows = rows.select("node", bit.alias("bit"), F.shiftright("h", 6).bitwiseAND(F.lit(FINE - 1)).cast("int").alias("word"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(f"y{w}") for w in range(FINE)]
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *words)


def _possible(pairs: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """``pairs`` without most of those whose lines don't have the similarity ``threshold``, and with all that have it.

    Each bit in which two bitmaps differ stands for a shingle that one line alone has at the least, and lines of that similarity have at
    most (1 - t) / (1 + t) of their shingles alone, which are no more than their positions.
    """
    maps = materialise(_bitmaps(lines))
    side = lambda s: maps.select(*[F.col(c).alias(s if c == "node" else f"{s}_{c}") for c in maps.columns])
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"a_y{w}").bitwiseXOR(F.col(f"b_y{w}"))) for w in range(FINE)])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(differ * (1 + threshold) <= (1 - threshold) * (F.col("a_n") + F.col("b_n")) + 1e-6)
    return near.select(pairs.columns)


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``pairs`` whose lines a and b have the similarity ``threshold``, on all their shingles.

    Only the lines in a pair travel. Where lines have many pairs each, bitmaps rule out most of them before texts meet; else making the
    bitmaps would cost more than the checks.
    """
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = nodes.select("node", "k1", "k2").join(named, "node")
    lines = materialise(texts.select("k1", "k2", "norm").join(keys.hint("shuffle_hash"), ["k1", "k2"]).select("node", "norm"))
    if pairs.count() > MANY * lines.count():
        pairs = _possible(pairs, lines, threshold)
    text = lambda s: lines.select(F.col("node").alias(s), F.col("norm").alias(f"{s}_norm"))
    both = pairs.join(text("a"), "a").join(text("b"), "b")
    # exploding one array keeps the optimiser from cutting both lines again for every use of their shingles
    both = both.select(*pairs.columns, F.inline(F.array(F.struct(_hashes("a_norm").alias("x"), _hashes("b_norm").alias("y")))))
    sizes = F.struct(F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("common"))
    both = both.select(*pairs.columns, F.inline(F.array(sizes)))
    return both.where(F.col("common") >= threshold * (F.col("nx") + F.col("ny") - F.col("common")) - 1e-9).select(pairs.columns)


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, head_id, head_line, keep) for every line that isn't blank: the place of the line that stays for it, and whether it is
    that line.

    Lines are compared after lower-casing and white space folding. Equal lines are one distinct line, by 128 bits of hash. Distinct
    lines get a signature of the character shingles at all their positions, in one permutation, cut into bands; lines that share a
    band and are alike by their sketches are candidates, checked by exact Jaccard similarity of all their shingles, by 64 bits of hash: in small
    buckets all at once, in others first each with the most frequent, then all that are still in different components. A distributed union-find makes components, and the
    line of the smallest (key, line_no) of each stays.

    Defined cases: null and blank lines have no row; null keys come first in order; equal lines of repeated rows count once each; a line of at
    most five characters has itself as shingle; very long lines are lines like any other; no rows give none.
    """
    place = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "line_no")
    lines = line_table(docs, key, text)
    with shuffles_dropped(docs.sparkSession):
        texts = clustered(lines.groupBy("k1", "k2").agg(F.first("norm").alias("norm"), F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")), "k1", "k2")
        nodes = _nodes(texts)
        rows = _buckets(nodes)
        large = rows.where(F.col("size") > SMALL).drop("size")
        pairs = materialise(_pairs(rows.where(F.col("size") <= SMALL).drop("size"), threshold).union(_stars(large, threshold)).distinct())
        links = materialise(_links(pairs, nodes, texts, threshold))
        more = materialise(_apart(large, connected_components(links), threshold))
        emptied(rows)
        if not more.isEmpty():
            more = _links(more, nodes, texts, threshold).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
            links = materialise(links.unionByName(more))
        classes = connected_components(links).join(nodes.select("node", "k1", "k2"), "node")
        classes = materialise(classes.join(texts.select("k1", "k2", "first"), ["k1", "k2"]).select("k1", "k2", "component", "first"))
        emptied(nodes)
    heads = classes.groupBy("component").agg(F.min("first").alias("head"))
    merged = classes.join(heads, "component").select("k1", "k2", "head")
    told = texts.select("k1", "k2", "first").join(merged, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("head", "first").alias("head"))
    out = lines.select("id", "line_no", "k1", "k2").join(told, ["k1", "k2"])
    head = F.when(F.col("head.known"), F.col("head.id"))
    keep = head.eqNullSafe(F.col("id")) & (F.col("line_no") == F.col("head.line_no"))
    return out.select(F.col("id").alias(key), "line_no", head.alias("head_id"), F.col("head.line_no").alias("head_line"), keep.alias("keep"))


def without_copies(docs: DataFrame, decided: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text cut to its kept and blank lines; rows of one key share their decisions."""
    lost = decided.where("NOT keep").groupBy(F.col(key).alias("_k")).agg(F.collect_set("line_no").alias("_lost"))
    joined = docs.join(lost, docs[key].cast("long").eqNullSafe(F.col("_k")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.coalesce("_lost", F.array().cast("array<int>")), i))
    return joined.withColumn(text, F.array_join(kept, "\n")).select(docs.columns)
