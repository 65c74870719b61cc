"""N-gram Jaccard join by chosen paths, and its classes of linked documents."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import connected_components, groups_of, materialise

WORDS_A_SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
#: Sampled tokens of a path at most; a bucket that is still large then is compared in blocks.
DEPTH = 3
#: A bucket of more sets than this is split further (or, at the end of its path, into blocks of this size).
SMALL = 256
SKETCH = 128
#: A pair is verified if its sketches agree in this share at least: over four deviations below the threshold.
PLAUSIBLE = 0.64
BLOCK_BYTES = 8 << 20
_PIECE = 1 << 20
_WORD = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float, threshold: float, depth: int) -> int:
    """Runs until a pair at the threshold that is split ``depth`` times is met with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], k: int = WORDS_A_SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of ``k`` lower-cased words; all words, if fewer; none, if no word."""
    lists = [_WORD.findall(t.lower()) if t else [] for t in texts]
    flat = np.array([w for ws in lists for w in ws], dtype=object)
    hashes = pd.util.hash_array(flat, categorize=False) if len(flat) else np.empty(0, np.uint64)
    out, at = [], 0
    for ws in lists:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        size = min(k, len(h))
        if not size:
            out.append(np.empty(0, np.uint64))
            continue
        n = len(h) - size + 1
        s = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            s = mixed(s * _MUL + h[j : j + n])
        out.append(np.unique(s))
    return out


def _seeds(n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * _MUL) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Row a set, column a permutation: the least permuted token (the sampled token of the set)."""
    out = np.zeros((len(sets), n), dtype=np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    flat = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
    part = np.empty((n, len(full)), dtype=np.uint64)
    for j, seed in enumerate(_seeds(n)):
        # multiplying by an odd number permutes 64 bits; the high bits, well mixed, decide the order
        part[j] = np.minimum.reduceat((flat ^ (seed >> np.uint64(7))) * seed, starts)
    out[full] = part.T
    return out


def _pieces(pdf: pd.DataFrame, text: str) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about ``_PIECE`` characters, so that memory follows neither batch nor document count."""
    size = pdf[text].str.len().fillna(0).to_numpy().cumsum()
    for _, part in pdf.groupby((size // _PIECE).astype("int64"), sort=False):
        yield part


def _index(runs: int, depth: int, k: int):
    """Per document: key of its set, and its sampled tokens and sketch."""
    n = max(SKETCH, runs * depth)

    def index(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _pieces(pdf, "text"):
                sets = shingle_sets(part["text"].tolist(), k)
                sig = signatures(sets, n)
                paths = mixed(sig[:, : runs * depth]).view(np.int64)
                sketch = (sig[:, :SKETCH] >> np.uint64(40)).astype(np.uint16)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:  # a frame of empty lists has no list columns
                    continue
                yield pd.DataFrame({
                    "id": part["id"].to_numpy()[some],
                    "set_key": [xxhash.xxh3_128_digest(sets[i].tobytes()) for i in some],
                    "path": [paths[i] for i in some],
                    "sketch": [sketch[i].tobytes() for i in some],
                })

    return index


class _Forest:
    """Union-find over numbers; the smaller side is relabelled, so that labels are always final."""

    def __init__(self, n: int) -> None:
        self.label, self.members = np.arange(n), {}

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = label[x], label[y]
            if a == b:
                continue
            ma, mb = self.members.pop(a, None) or [a], self.members.pop(b, None) or [b]
            if len(ma) < len(mb):
                a, ma, mb = b, mb, ma
            label[mb] = a
            self.members[a] = ma + mb

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """An edge from every number to the smallest of its set, but for that itself. The same set found again, in another
        run or bucket, gives the same edges."""
        n = len(self.label)
        root = np.full(n, n)
        np.minimum.at(root, self.label, np.arange(n))
        i = np.flatnonzero(root[self.label] != np.arange(n))
        return i, root[self.label[i]]


def _plausible(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Brute force over the small buckets of a sorted partition, by sketches: star edges of what is plausible.

    All pairs at one distance in sorted order are compared at once, so thousands of small buckets take one numpy
    call. No pair leaves the task: at most one edge a document does.
    """
    need = math.ceil(PLAUSIBLE * SKETCH)
    held: list[pd.DataFrame] = []

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, node = np.unique(pdf["id"].to_numpy(), return_inverse=True)
        bucket = pdf.groupby(["bucket", "bi", "bj"], sort=False).ngroup().to_numpy()
        cross, side = (pdf["bi"] != pdf["bj"]).to_numpy(), pdf["side"].to_numpy()
        sk = np.frombuffer(b"".join(pdf["sketch"]), dtype=np.uint16).reshape(len(pdf), SKETCH)
        forest = _Forest(len(ids))
        for d in range(1, len(pdf)):
            i = np.flatnonzero(bucket[:-d] == bucket[d:])
            if not len(i):
                break
            i = i[~cross[i] | (side[i] != side[i + d])]
            i = i[forest.label[node[i]] != forest.label[node[i + d]]]
            if len(i):
                agree = np.concatenate([(sk[x] == sk[x + d]).sum(axis=1) for x in np.array_split(i, -(-len(i) // 20_000))])
                hit = i[agree >= need]
                forest.join(node[hit], node[hit + d])
        a, b = forest.stars()
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    rows = 0
    for pdf in batches:
        if not len(pdf):
            continue
        last = pdf.iloc[-1][["bucket", "bi", "bj"]]
        open_ = ((pdf["bucket"] == last.iloc[0]) & (pdf["bi"] == last.iloc[1]) & (pdf["bj"] == last.iloc[2])).to_numpy()
        cut = len(pdf) - int(open_[::-1].cumprod().sum())
        if cut:
            yield work(pd.concat([*held, pdf.iloc[:cut]]))
            held, rows = [], 0
        held.append(pdf.iloc[cut:])
        rows += len(pdf) - cut
    if held:
        yield work(pd.concat(held))


def _verify(k: int, threshold: float):
    """Exact Jaccard over the whole texts of a family (or two blocks of one): links of every row, and star edges."""

    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for g in groups_of(batches, ["family", "bi", "bj"]):
            ids, copies = g["id"].to_numpy(), g["copies"].to_numpy()
            side, cross = g["side"].to_numpy(), bool(g["bi"].iloc[0] != g["bj"].iloc[0])
            sets = shingle_sets(g["text"].tolist(), k)
            links = np.zeros(len(ids), dtype=np.int64)
            forest = _Forest(len(ids))
            for i, j in _near(sets, threshold):
                keep = side[i] != side[j] if cross else np.ones(len(i), dtype=bool)
                i, j = i[keep], j[keep]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                apart = forest.label[i] != forest.label[j]
                forest.join(i[apart], j[apart])
            rows += [(int(ids[i]), int(ids[j]), 0) for i, j in zip(*forest.stars(), strict=True)]
            rows += [(int(ids[i]), None, int(links[i])) for i in np.flatnonzero(links)]
            if len(rows) > 20_000:
                yield frame(rows)
                rows = []
        yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return verify


def _near(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose sets reach the threshold, a row of the upper triangle at a time; tokens of one set alone are not looked at."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if both and both >= threshold * (sizes[0] + sizes[1] - both) - 1e-9:
            yield np.array([0]), np.array([1])
        return
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[start, len(flat)])
    group = np.repeat(np.arange(len(start)), count)
    shared = count[group] > 1
    # columns with the same owners weigh together: near copies share most of their tokens with the same others
    common = np.zeros((n, n), dtype=np.int64)
    g, o = group[shared], owner[shared]
    g = np.unique(g, return_inverse=True)[1] if len(g) else g
    for a in range(0, int(g[-1]) + 1 if len(g) else 0, 4096):
        lo, hi = np.searchsorted(g, [a, a + 4096])
        x = np.zeros((n, 4096), dtype=np.float32)
        x[o[lo:hi], g[lo:hi] - a] = 1
        common += (x @ x.T).astype(np.int64)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        both = common[i, i + 1 :]
        hit = (both > 0) & (both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9)
        if hit.any():
            yield np.full(int(hit.sum()), i), j[hit]


def _blocks(df: DataFrame, blocks: str) -> DataFrame:
    """Rows for every pair of blocks (bi <= bj) that a row's own block is in; ``side`` tells which of the two it is."""
    mine = F.pmod(F.xxhash64(F.lit(11), "id"), F.col(blocks)).cast("int")
    df = df.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return (
        df.withColumn("bi", F.least("mine", "other")).withColumn("bj", F.greatest("mine", "other"))
        .withColumn("side", (F.col("mine") > F.col("other")).cast("int")).drop("mine", "other", blocks)
    )


def link_classes(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS_A_SHINGLE, recall: float = TARGET_RECALL,
    small: int = SMALL, depth: int = DEPTH, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, class_id, n_links): the class of linked documents by its smallest key, and to how many other
    documents each one has a Jaccard similarity of ``threshold`` or more on shingles of ``words`` words.

    1. Documents of equal shingle sets are one set. 2. Every run samples a shared token (least under the run's
    permutation) of every set; sets of one token are a bucket. Buckets over ``small`` are split by the next sampled
    token, up to ``depth``; what no token splits is compared block by block. Small buckets are compared all with all by
    sketches. Runs repeat until a pair at the threshold is met with probability ``recall``. 3. Plausible pairs span
    families; the whole texts of a family are compared exactly, in blocks of bounded size, and links are counted
    there. 4. A distributed union-find over the exact links gives the classes.

    Nothing is capped: large buckets and families are split into blocks that meet pairwise. Copies count as links.
    Defined cases: null, empty or wordless texts are classes of their own without links; a text of fewer words is one
    shingle; null keys have a null class and 0 links; rows that share a key count as one document; no rows give none.
    """
    runs = runs_for(recall, threshold, depth)
    ids = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id IS NOT NULL")
    index = ids.mapInPandas(_index(runs, depth, words), "id long, set_key binary, path array<long>, sketch binary")
    index = materialise(index)
    sets = index.groupBy("set_key").agg(
        F.min("id").alias("id"), F.countDistinct("id").alias("copies"), F.first("path").alias("path"), F.first("sketch").alias("sketch")
    )
    sets = materialise(sets)
    families = connected_components(_candidates(sets, runs, depth, small))
    edges = _exact(ids, sets.select("id", "copies"), families, words, threshold, small)
    links = edges.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("linked"))
    classes = connected_components(edges.where("b IS NOT NULL").select("a", "b"))
    of_set = (
        sets.select("set_key", F.col("id").alias("first"), "copies")
        .join(classes, F.col("first") == F.col("node"), "left")
        .join(links, F.col("first") == F.col("a"), "left")
        .select(
            "set_key", F.coalesce("component", "first").alias("class_id"),
            (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies", "first",
        )
    )
    # only sets with links or copies have anything to say about their documents
    told = index.select("id", "set_key").join(of_set.where("n_links > 0 OR class_id <> first"), "set_key")
    told = told.groupBy(F.col("id").alias("told_id")).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    out = docs.select(F.col(key)).join(told, F.col(key).cast("long") == F.col("told_id"), "left")
    return out.select(
        key, F.coalesce("class_id", F.col(key).cast("long")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def _candidates(sets: DataFrame, runs: int, depth: int, small: int) -> DataFrame:
    """Spanning edges (a, b) of the plausible pairs of all buckets."""
    rows = sets.select("id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.slice("path", r * depth + 1, depth)
    )).alias("run", "path"))
    rows = rows.select("id", "path", F.xxhash64("run", F.element_at("path", 1)).alias("bucket"))
    done: DataFrame | None = None
    for level in range(1, depth + 1):
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        rows = materialise(rows.join(sizes, "bucket"))
        end = rows if level == depth else rows.where(F.col("size") <= small)
        end = end.select("id", "bucket", F.ceil(F.col("size") / small).cast("int").alias("blocks"))
        done = end if done is None else done.unionByName(end)
        if level < depth:
            rows = rows.where(F.col("size") > small).select(
                "id", "path", F.xxhash64("bucket", F.element_at("path", level + 1)).alias("bucket")
            )
            if rows.isEmpty():
                break
    work = _blocks(done, "blocks").join(sets.select("id", "sketch"), "id")
    work = work.repartition("bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj", "id")
    return work.select("bucket", "bi", "bj", "side", "id", "sketch").mapInPandas(_plausible, "a long, b long").distinct()


def _exact(ids: DataFrame, sets: DataFrame, families: DataFrame, words: int, threshold: float, small: int) -> DataFrame:
    """(a, b, n): spanning edges of the exact links (n = 0), and for each set (b null) the documents it is linked to."""
    members = families.select(F.col("node").alias("id"), F.col("component").alias("family")).join(sets, "id")
    texts = ids.join(members, "id").groupBy("family", "id").agg(F.max("copies").alias("copies"), F.max("text").alias("text"))
    texts = materialise(texts)
    sizes = texts.groupBy("family").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / small), F.ceil(F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks")
    )
    work = _blocks(texts.join(sizes, "family"), "blocks")
    work = work.repartition("family", "bi", "bj").sortWithinPartitions("family", "bi", "bj", "id")
    return materialise(work.select("family", "bi", "bj", "side", "id", "copies", "text").mapInPandas(_verify(words, threshold), "a long, b long, n long"))


def keep_first(docs: DataFrame, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of each class's smallest key, but each different row once; rows with a null key are all kept.

    Rows that share a key but differ stay all: no text is lost, and nothing depends on the order of reading."""
    lost = classes.where(F.col("class_id") != F.col(key)).select(F.col(key)).distinct()
    kept = docs.where(F.col(key).isNotNull()).join(lost, key, "left_anti").select(docs.columns).distinct()
    return kept.unionByName(docs.where(F.col(key).isNull()))
