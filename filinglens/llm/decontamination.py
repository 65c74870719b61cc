"""Benchmark decontamination with a generalised suffix automaton of the items' words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free_name, materialise

WINDOW = 10
#: A document that is contaminated beyond this share of its words is dropped rather than cut.
MAX_COVERAGE = 0.5
#: Bytes of benchmark text in one automaton; a larger benchmark is taken in several passes of that size.
CHUNK_BYTES = 1 << 20

#: Words are runs of digits, a-z and everything beyond ASCII, after lower-casing A-Z only.
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


class SuffixAutomaton:
    """All substrings of several word sequences. A state knows its longest length, its suffix link and the items
    in which its substrings occur."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.short: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            known = self.next[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, word)
        return new

    def _split(self, at: int, known: int, word: int) -> int:
        twin = self._state(self.length[at] + 1, dict(self.next[known]), self.link[known])
        self.link[known] = twin
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, seq: list[int]) -> None:
        last = 0
        for word in seq:
            last = self._extend(last, word)

    def mark(self, seq: list[int], item: int, window: int) -> None:
        """Note ``item`` at every state on the way of ``seq`` and its suffix links; a short item at its own end."""
        at = 0
        for word in seq:
            at = self.next[at][word]
            up = at
            while up > 0 and item not in self.items[up]:
                self.items[up].add(item)
                up = self.link[up]
        if seq and len(seq) < window:
            self.short.setdefault(at, []).append((len(seq), item))

    def settle(self, window: int) -> None:
        """For every state: the items of its suffix of ``window`` words, and the short items that are suffixes."""
        n = len(self.next)
        self.long_items: list[frozenset[int]] = [frozenset()] * n
        self.short_all: list[tuple[tuple[int, int], ...]] = [()] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= window:
                self.long_items[s] = frozenset(self.items[s]) if self.length[up] < window else self.long_items[up]
            self.short_all[s] = (*self.short_all[up], *self.short.get(s, ()))
        del self.items


class Matcher:
    """The automaton with its vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        seqs = [words(t) for _, t in items]
        self.names, self.window = [i for i, _ in items], window
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for s in seqs for w in s}), 1)}
        coded = [[self.vocabulary[w] for w in s] for s in seqs]
        self.automaton = SuffixAutomaton()
        for seq in coded:
            self.automaton.add(seq)
        for i, seq in enumerate(coded):
            self.automaton.mark(seq, i, window)
        self.automaton.settle(window)
        self.least = min([window, *(len(s) for s in seqs if s)])

    def match(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Maximal hit spans [start, end) of word positions, and the items with occurring windows."""
        get, spans, found = self.vocabulary.get, [], set()
        codes = [get(t, 0) for t in tokens]
        if len(codes) < self.least or not self.names:
            return [], found
        edges = np.zeros(len(codes) + 2, dtype=np.int8)
        edges[1:-1] = np.array(codes, dtype=np.int64) > 0
        known = np.flatnonzero(np.diff(edges))
        sa = self.automaton
        for start, end in zip(known[::2].tolist(), known[1::2].tolist(), strict=True):
            if end - start < self.least:
                continue
            state = length = 0
            for i in range(start, end):
                word = codes[i]
                while state and word not in sa.next[state]:
                    state = sa.link[state]
                    length = sa.length[state]
                if word in sa.next[state]:
                    state, length = sa.next[state][word], length + 1
                back = 0
                if length >= self.window:
                    back = self.window
                    found.update(sa.long_items[state])
                for size, item in sa.short_all[state]:
                    if size <= length:
                        back = max(back, size)
                        found.add(item)
                if back:
                    a, b = i + 1 - back, i + 1
                    if spans and a <= spans[-1][1]:
                        while spans and a <= spans[-1][1]:
                            a = min(a, spans.pop()[0])
                    spans.append((a, b))
        return spans, {self.names[i] for i in found}


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` (and what stands between them), joined by one space where cut."""
    raw = text.encode("utf-8", "surrogatepass")
    kept = raw.translate(_KEEP)
    starts = [i for i, (a, b) in enumerate(zip(b" " + kept, kept, strict=False)) if a == 32 and b != 32]
    ends = [i for i, (a, b) in enumerate(zip(kept, kept[1:] + b" ", strict=True), 1) if a != 32 and b == 32]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    out.append(raw[at:])
    parts = [p for x in out if (p := x.decode("utf-8", "surrogatepass").strip())]
    return " ".join(parts)


def _chunks(benchmark: DataFrame, item: str, text: str, chunk_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in pieces of bounded bytes; only one piece is on the driver at a time."""
    b = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = b.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    pieces = max(1, -(-total * 2 // chunk_bytes) if total > chunk_bytes else 1)
    for k in range(pieces):
        part = b if pieces == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(pieces)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text",
    item: str = "item_id", chunk_bytes: int = CHUNK_BYTES, max_coverage: float = MAX_COVERAGE, cut: bool = False,
) -> DataFrame:
    """``docs`` without ``text`` (with it, cleaned, if ``cut``) plus ``n_words``, ``spans`` (array of word positions start,
    end), ``items`` (sorted array), ``n_hit`` and ``coverage``; with ``cut`` also ``drop``: more than
    ``max_coverage`` of the words are hit.

    Every run of ``window`` consecutive words of an item counts wherever it occurs; an item of fewer words
    counts as a whole. The automaton is broadcast; its input is bounded by ``chunk_bytes``, and a
    benchmark beyond that is taken in pieces, one pass of the documents each, whose spans are merged.

    Defined cases: null or empty text has no words, no spans and coverage 0 (cut: unchanged); null items, null item ids and
    items without words never occur; repeated items count once an id; no items leave all clean; columns of
    ``docs`` that have the name of a new column are replaced.
    """
    new = ["n_words", "spans", "items", "n_hit", "coverage", *(["drop"] if cut else [])]
    docs = docs.drop(*new)
    spark = docs.sparkSession
    result, cols = docs, []
    for k, piece in enumerate(_chunks(benchmark, item, text, chunk_bytes)):
        if k:
            result = materialise(result)  # so that a worker holds one automaton at a time
        matcher = spark.sparkContext.broadcast(Matcher(piece, window))
        # called non-deterministic so that a later filter on its result doesn't run it a second time
        found = F.pandas_udf(_finder(matcher), "n_words long, starts array<int>, ends array<int>, items array<string>").asNondeterministic()
        cols.append(free_name(result, f"_found{k}"))
        result = result.withColumn(cols[-1], found(F.col(text)))
    merge = F.pandas_udf(_merge, "n_hit long, starts array<int>, ends array<int>")
    if len(cols) > 1:
        joined = merge(F.concat(*[F.col(f"{c}.starts") for c in cols]), F.concat(*[F.col(f"{c}.ends") for c in cols]))
        items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.items") for c in cols])))
    else:
        joined, items = F.col(cols[0]), F.col(f"{cols[0]}.items")
    merged = free_name(result, "_merged")
    result = result.withColumn(merged, joined)
    pairs = F.arrays_zip(F.col(f"{merged}.starts").alias("start"), F.col(f"{merged}.ends").alias("end"))
    result = (
        result.withColumn("n_words", F.col(f"{cols[0]}.n_words"))
        .withColumn("spans", pairs)
        .withColumn("items", items)
        .withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)"))
        .withColumn("coverage", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0))
        .drop(*cols, merged)
    )
    if not cut:
        return result.drop(text)
    cleaner = F.pandas_udf(_cleaner, "string")
    clean = F.when(F.col("n_hit") > 0, cleaner(F.when(F.col("n_hit") > 0, F.col(text)), F.col("spans.start"), F.col("spans.end")))
    return result.withColumn("drop", F.col("coverage") > max_coverage).withColumn(text, F.coalesce(clean, F.col(text)))


def _finder(matcher: Broadcast):
    def find(batches: Iterable[pd.Series]) -> Iterator[pd.DataFrame]:
        m = matcher.value
        for texts in batches:
            rows = []
            for t in texts:
                tokens = words(t)
                spans, items = m.match(tokens)
                rows.append((len(tokens), [a for a, _ in spans], [b for _, b in spans], sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return find


def _merge(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(starts, ends, strict=True):
        spans: list[list[int]] = []
        for x, y in sorted(zip(a, b, strict=True)):
            if spans and x <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], y)
            else:
                spans.append([x, y])
        rows.append((sum(y - x for x, y in spans), [x for x, _ in spans], [y for _, y in spans]))
    return pd.DataFrame(rows, columns=["n_hit", "starts", "ends"])


def _cleaner(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([
        _cut(t, list(zip(a, b, strict=True))) if t and a is not None and len(a) else t for t, a, b in zip(texts, starts, ends, strict=True)
    ], dtype=object)
