"""Audit of how far the sources of a language lie apart in their terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .base import materialise

SCALE = 10**9
#: A task's tallies are handed on once they hold so many entries.
HELD = 300_000
#: Terms times sources of one block of term ids.
CELLS = 1 << 18
#: Bytes of a text that are split at once.
PIECE = 1 << 20

#: Terms are runs of a-z and everything beyond ASCII, after lower-casing A-Z only.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists from at most about ``PIECE`` bytes (or one term, if that is longer)."""
    data = text.encode("utf-8", "surrogatepass").translate(_KEEP)
    start = 0
    while start < len(data):
        end = len(data) if len(data) - start <= PIECE else data.find(b" ", start + PIECE)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, source, term, n, docs) of a task's rows, added up as far as ``HELD`` allows; a null term marks a group that occurs."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pd.DataFrame]:
        for (lang, source), (n, docs) in seen.items():
            names = [None, *(t.decode("utf-8", "replace") for t in n)]
            same = {c: pd.Series([v] * len(names), dtype=object) for c, v in (("lang", lang), ("source", source))}
            yield pd.DataFrame({**same, "term": pd.Series(names, dtype=object), "n": [0, *n.values()], "docs": [0, *(docs[t] for t in n)]})

    for batch in batches:
        for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for found in terms(text):
                n.update(found)
                own.update(found)
            docs.update(own)
            held += len(n) - before
            if held > HELD:
                yield from rows()
                seen, held = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of a group, and one row with a null term a group."""
    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    part = some.mapInPandas(_tally, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class SegmentTrees:
    """Segment trees over the same term ids, one a group, whose equal subtrees are one node (wherever and in whichever tree they are).

    ``counts`` has a row a group and a column a term id. Ids are padded to a power of two by leaves that aren't terms.
    """

    def __init__(self, counts: np.ndarray) -> None:
        width = 1
        while width < counts.shape[1]:
            width *= 2
        padded = np.full((counts.shape[0], width), -1, dtype=np.int64)
        padded[:, : counts.shape[1]] = counts
        self.leaves, ids = np.unique(padded, return_inverse=True)
        ids = ids.reshape(padded.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # children of a level's nodes, from the leaves up
        while ids.shape[1] > 1:
            base = int(ids.max()) + 1
            nodes, inverse = np.unique(ids[:, ::2] * base + ids[:, 1::2], return_inverse=True)
            self.levels.append((nodes // base, nodes % base))
            ids = inverse.reshape(ids.shape[0], -1)
        self.roots = ids[:, 0]

    def leaf_pairs(self, g: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs of leaves that meet in both trees, and how often: both are walked down together, and a pair of nodes that was
        met before is only counted."""
        x, y, times = self.roots[[g]], self.roots[[h]], np.ones(1, dtype=np.int64)
        for left, right in reversed(self.levels):
            x, y, times = np.concatenate([left[x], right[x]]), np.concatenate([left[y], right[y]]), np.concatenate([times, times])
            base = int(y.max()) + 1
            pairs, inverse = np.unique(x * base + y, return_inverse=True)
            x, y, times = pairs // base, pairs % base, np.bincount(inverse, times).astype(np.int64)
        return x, y, times


def shares(counts: list[int], total: int, size: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / (total + size)) of each count, in whole numbers of any size; 1 for what isn't a term."""
    return np.array([1 + SCALE * (c + 1) // (total + size) if c >= 0 else 1 for c in counts], dtype=np.int64)


def _price(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block's part of the value of every ordered pair of its language's sources."""
    heads = pdf[pdf["id"].isna()].sort_values("source")
    names, totals, size = heads["source"].tolist(), heads["total"].astype("int64").tolist(), int(heads["size"].iloc[0])
    cells = pdf[pdf["id"].notna()]
    rows: list[tuple[str, str, int]] = []
    if size and len(cells):
        ids = cells["id"].to_numpy(dtype=np.int64) - 1
        counts = np.zeros((len(names), int(ids.max()) + 1), dtype=np.int64)
        place = {s: i for i, s in enumerate(names)}
        counts[cells["source"].map(place).to_numpy(), ids] = cells["n"].to_numpy(dtype=np.int64)
        trees = SegmentTrees(counts)
        leaves = trees.leaves.tolist()
        p = [shares(leaves, t, size) for t in totals]
        for g in range(len(names)):
            for h in range(g):
                x, y, times = trees.leaf_pairs(g, h)
                a, b = p[g][x], p[h][y]
                square = (a - b) * (a - b)
                rows.append((names[g], names[h], int((square // b * times).sum())))
                rows.append((names[h], names[g], int((square // a * times).sum())))
    else:
        rows = [(s, o, 0) for s in names for o in names if s != o]
    lang = pdf["lang"].iloc[0]
    out = pd.DataFrame([(lang, *r) for r in rows], columns=["lang", "source", "item", "value"], dtype=object)
    return out.astype({"value": "int64"})


def divergence(
    docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 3, top: int = 200, cells: int = CELLS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each (lang, source) group lies from each other source of its language (``pair``),
    and its ``top`` terms that are more frequent in it than in the language (``term``).

    A group gives a kept term (in at least ``least_docs`` documents of the language) the smoothed share
    p = 1 + floor(10^9 (count + 1) / (N + V)); against a share q a term is worth floor((p - q)^2 / q). A pair's value is the sum
    over all kept terms with q of the other source; a term's is taken against the share q in the whole language.

    Tasks add up their rows before the shuffle. Terms are dealt by hash over blocks of about ``cells`` / sources ids, numbered from
    the most frequent on, so rare terms lie together and their subtrees are alike; a block's trees share nodes, and each pair of
    sources walks its two trees once (``SegmentTrees``). Blocks' parts are added by Spark. A block's task holds sources x ids
    counts; the rows a language's pairs make, its sources squared, are those returned.

    Defined cases: null lang, source and text are empty strings; a group without terms takes part with counts of 0; without kept terms
    pairs are worth 0 and no terms are listed; a language of one source has no pairs; repeated rows count each; no rows
    give none; ties go by the item's UTF-8. Other columns of ``docs`` are not looked at.
    """
    counts = materialise(term_counts(docs, lang, source, text))
    same = W.partitionBy("lang", "term")
    spread = counts.where("term IS NOT NULL").withColumns({
        "all": F.sum("n").over(same), "in_docs": F.sum("docs").over(same), "first": (F.min("source").over(same) == F.col("source")).cast("long"),
    })
    kept = materialise(spread.where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "all", "first"))
    groups = counts.where("term IS NULL").select("lang", "source")
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("size"))
    groups = groups.join(own, ["lang", "source"], "left").na.fill(0, ["total", "size"])
    whole = W.partitionBy("lang")
    groups = materialise(groups.select(
        "lang", "source", "total", F.sum("size").over(whole).alias("size"), F.sum("total").over(whole).alias("lang_total"), F.count(F.lit(1)).over(whole).alias("sources"),
    ))

    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") * F.col("sources") / cells)).cast("int")
    langs = groups.groupBy("lang").agg(F.first("size").alias("size"), F.first("sources").alias("sources")).select("lang", blocks.alias("blocks"))
    dealt = kept.join(langs, "lang").withColumn("block", F.expr("pmod(xxhash64(term), blocks)").cast("int"))
    number = F.dense_rank().over(W.partitionBy("lang", "block").orderBy(F.desc("all"), "term"))
    none = F.lit(None).cast("long")
    body = dealt.select("lang", "block", "source", number.cast("long").alias("id"), "n", none.alias("total"), none.alias("size"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    heads = heads.select("lang", "block", "source", none.alias("id"), none.alias("n"), "total", "size")
    priced = body.unionByName(heads).groupBy("lang", "block").applyInPandas(_price, "lang string, source string, item string, value long")
    pairs = priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    share = lambda n, total: F.expr(f"1 + (cast({n} + 1 AS decimal(20, 0)) * {SCALE}) div ({total} + size)")
    scored = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("`all`", "lang_total").alias("q"))
    scored = scored.where("p > q").select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    listed = scored.withColumn("rank", rank).where(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs.withColumn("rank", rank), "pair").unionByName(columns(listed, "term"))
