"""Main text of pages by wrappers: union-free regular expressions inferred from the token streams of a host."""

from __future__ import annotations

import bisect
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .base import materialise

#: Pages that a wrapper is inferred from, of each template of a host, chosen by hash; the wrapper is applied to every page of it. The
#: templates are found on all pages: they agree in host, kind (with and without article or main tags) and shape.
SAMPLE_PAGES = 6
#: The share of the varying text that a container holds at least.
MOST = 0.6
SALTS = 16
#: Rows of the sample's keys, and bytes of wrappers, that are broadcast at most; beyond that the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20

#: Fixed values of the markup language, and words of class and id names that tell what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
INLINE_END_AT = frozenset("p h1 h2 h3 h4 h5 h6".split())
SIBLINGS = frozenset("li dd dt tr td th option".split())
OUTSIDE = frozenset(
    "nav footer aside form script style head noscript template iframe svg button select textarea menu dialog input object canvas".split()
)
MAIN = frozenset(["article", "main"])
PARTS = frozenset("li td th tr tbody thead tfoot ul ol dl dd dt header footer".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "login masthead menu modal nav navbar navigation newsletter notice notices popup promo recommended related reply replies search share "
    "sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_LABEL = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

Token = tuple[str, str]  # kind ("<", ">", "#") and label or text


def tokens(page: str) -> list[Token]:
    """Tags as ("<" or ">", label) and text as ("#", decoded). A label is the tag name, with the words of class, id and
    role. Comments, declarations and the inside of scripts, styles and their like are left out."""
    out: list[Token] = []
    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        at = m.end()
        if (text := m["text"]) is not None:
            out.append(("#", html_lib.unescape(text) if "&" in text else text))
        elif (name := m["name"]) is not None:
            name = name.lower()
            if m["close"]:
                out.append((">", name))
                continue
            attrs = m["attrs"]
            label = name
            if attrs and ("=" in attrs):
                found = " ".join(next(x for x in f[1:] if x or f[-1] == x) for f in _LABEL.findall(attrs))
                if found:
                    # words with long numbers tell pages apart, not templates
                    marks = {w for w in re.split(r"[^a-z0-9_-]+", found.lower()) if w and sum(c.isdigit() for c in w) < 3}
                    label = ".".join([name, *sorted(marks)])
            if name in RAW and not attrs.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
                continue
            out.append(("<", label))
            if name in VOID or attrs.rstrip().endswith("/"):
                out.append((">", name))
    return out


class Paths:
    """The open elements of a page as nodes of a tree: a path is one number, however deep it is."""

    def __init__(self) -> None:
        self.parent, self.label, self.depth = [-1], [""], [0]
        self._below: dict[tuple[int, str], int] = {}

    def down(self, node: int, label: str) -> int:
        known = self._below.get((node, label))
        if known is None:
            known = self._below[node, label] = len(self.parent)
            self.parent.append(node)
            self.label.append(label)
            self.depth.append(self.depth[node] + 1)
        return known

    def labels(self, node: int) -> tuple[str, ...]:
        """The labels of a path, from the outermost on."""
        out = []
        while node:
            out.append(self.label[node])
            node = self.parent[node]
        return tuple(reversed(out))

    def add_up(self, at: dict[int, int]) -> list[int]:
        """For every node the sum of the numbers at it and below it; parents come first."""
        sums = [0] * len(self.parent)
        for node, n in at.items():
            sums[node] = n
        for node in range(len(sums) - 1, 0, -1):
            sums[self.parent[node]] += sums[node]
        return sums

    def inherit(self, test: Callable[[int], bool]) -> list[bool]:
        """For every node whether the test holds for it or a node above it."""
        out = [False] * len(self.parent)
        for node in range(1, len(out)):
            out[node] = out[self.parent[node]] or test(node)
        return out


def placed(toks: list[Token], paths: Paths) -> Iterator[tuple[int, int, str | None]]:
    """(index, path, text or None for a block's edge) for what a reader sees, with unclosed tags closed as browsers do."""
    stack: list[tuple[str, int]] = []  # names and paths
    open_: Counter = Counter()

    def cut(k: int) -> None:
        for name, _ in stack[k:]:
            open_[name] -= 1
        del stack[k:]

    for i, (kind, label) in enumerate(toks):
        here = stack[-1][1] if stack else 0
        if kind == "#":
            yield i, here, label
            continue
        name = label.split(".", 1)[0]
        if kind == "<":
            if name in BLOCK:
                same = name in SIBLINGS and open_[name] > 0
                if same or any(open_[x] > 0 for x in INLINE_END_AT):
                    for k in range(len(stack) - 1, -1, -1):
                        opened = stack[k][0]
                        if opened in INLINE_END_AT or (same and opened == name):
                            cut(k)
                            break
                        if opened in BLOCK:
                            break
                here = stack[-1][1] if stack else 0
                yield i, here, None
            elif name == "br":
                yield i, here, " "
            if name not in VOID:
                stack.append((name, paths.down(here, label)))
                open_[name] += 1
            continue
        if name in VOID:
            continue
        if open_[name] > 0:
            k = len(stack) - 1
            while stack[k][0] != name:
                k -= 1
            cut(k)
        if name in BLOCK:
            yield i, stack[-1][1] if stack else 0, None


def excluded(label: str) -> bool:
    """Whether an element is no part of an article, by its name, or, a block, by a word of its class, id or role: the whole mark or its
    last part (site-footer), unless that says what a layout has (with-sidebar)."""
    name, *marks = label.split(".")
    if name in OUTSIDE:
        return True
    if name not in BLOCK or name in ("html", "body", "header", *MAIN):
        return False
    for mark in marks:
        first, *more = re.split("[-_]+", mark)
        if (more[-1] if more else first) in OUTSIDE_WORDS and not (more and first in ("with", "has", "no", "without")):
            return True
    return False


@dataclass
class Node:
    """One term of a union-free expression: a tag, a text (``slot`` if it varies), a group ("+" repeated, "?" optional)."""

    kind: str
    label: str = ""
    path: int = 0  # of a text: its node in the tree of all pages' paths
    slot: bool = False
    chars: int = 0
    inner: list["Node"] = field(default_factory=list)

    def key(self) -> tuple:
        """What alignment compares: structure without texts."""
        if self.kind == "#":
            return ("#",)
        if self.kind in "<>":
            return (self.kind, self.label)
        return ("+", *(n.key() for n in self.inner)) if self.kind == "+" else ("?", *(n.key() for n in self.inner))

    def show(self) -> str:
        if self.kind == "#":
            return "#PCDATA" if self.slot else json.dumps(self.label)
        if self.kind in "<>":
            return f"<{self.label}>" if self.kind == "<" else f"</{self.label}>"
        return f"({' '.join(n.show() for n in self.inner)}){self.kind}"


def stream(page: str, tree: Paths) -> list[Node]:
    """The tokens of a page as expression terms; space between tags is no term. Paths are nodes of ``tree``, which pages share."""
    toks = tokens(page)
    paths = {i: p for i, p, t in placed(toks, tree) if t is not None}
    out = []
    for i, (kind, label) in enumerate(toks):
        if kind == "#":
            if text := _SPACE.sub(" ", label).strip():
                out.append(Node("#", text, paths.get(i, 0), False, len(text)))
        else:
            out.append(Node(kind, label))
    return out


def fold(nodes: list[Node], units: set[tuple] = frozenset()) -> list[Node]:
    """Tandem repeats (and single occurrences of a known unit) become repeated groups, short units first, of any length."""
    known: dict[tuple, int] = {}
    heads: dict[int, set[tuple]] = {}  # known units by length
    for u in units:
        heads.setdefault(len(u) - 1, set()).add(u[1:])
    keys: list[tuple] | None = None
    size = 0
    while True:
        if keys is None:
            keys = [n.key() for n in nodes]
            codes = np.array([known.setdefault(k, len(known)) for k in keys], dtype=np.int64)
            sizes = sorted(_distances(codes.tolist()) | set(heads))
        at = bisect.bisect_right(sizes, size)
        if at == len(sizes) or sizes[at] > len(nodes):
            return nodes
        size = sizes[at]
        same = np.append(codes[:-size] == codes[size:], False)  # a term and the one a unit later
        ends = np.flatnonzero(~same)
        run = ends[np.searchsorted(ends, np.arange(len(same)))] - np.arange(len(same))
        wanted = heads.get(size, frozenset())
        first = {u[0] for u in wanted}
        if not first and not (run >= size).any():
            continue
        out: list[Node] = []
        i, folded = 0, False
        while i < len(nodes):
            n = int(run[i]) // size + 1 if i < len(run) else 1
            single = n == 1 and keys[i] in first and i + size <= len(nodes) and tuple(keys[i : i + size]) in wanted
            if (n > 1 or single) and _closed(nodes[i : i + 1]):
                group = nodes[i : i + size]
                for k in range(1, n):
                    group = [_merge(a, b) for a, b in zip(group, nodes[i + k * size : i + (k + 1) * size], strict=True)]
                out.append(Node("+", inner=group))
                i += n * size
                folded = True
            else:
                out.append(nodes[i])
                i += 1
        if folded:
            nodes, keys = out, None


def _distances(codes: list[int]) -> set[int]:
    """The lengths that repeated units may have: how far a term, alone and with both neighbours, is from where it stood last."""
    out = set(range(1, 13))
    for seen in (codes, list(zip([-1, *codes], codes, [*codes[1:], -1], strict=False))):
        last: dict = {}
        for i, c in enumerate(seen):
            if c in last:
                out.add(i - last[c])
            last[c] = i
    return out


def _closed(nodes: list[Node]) -> bool:
    """A unit begins with an opening tag (a row of groups and texts alone is no unit)."""
    return nodes[0].kind == "<"


def _merge(a: Node, b: Node) -> Node:
    """The least general term of two of equal key."""
    if a.kind == "#":
        return Node("#", a.label, a.path, a.slot or b.slot or a.label != b.label, a.chars + b.chars)
    if a.kind in "<>":
        return a
    return Node(a.kind, inner=[_merge(x, y) for x, y in zip(a.inner, b.inner, strict=True)])


def units_of(nodes: list[Node]) -> set[tuple]:
    return {n.key() for n in nodes if n.kind == "+"} | {u for n in nodes for u in units_of(n.inner)}


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """The expression for both: equal terms merge, differing texts become slots, what only one side has becomes optional."""
    out: list[Node] = []
    bare = lambda ns: [n.inner if n.kind == "?" else [n] for n in ns]
    fa = [x for part in bare(a) for x in part]
    optional = {id(x) for n in a if n.kind == "?" for x in n.inner}

    def put(nodes: list[Node]) -> None:
        if not nodes:
            return
        if out and out[-1].kind == "?":
            out[-1].inner.extend(nodes)
        else:
            out.append(Node("?", inner=list(nodes)))

    known: dict[tuple, int] = {}
    ca, cb = ([known.setdefault(n.key(), len(known)) for n in ns] for ns in (fa, b))
    i = k = 0
    for j, n in [*common(ca, cb), (len(fa), len(b))]:
        put(fa[i:j])
        put(b[k:n])
        if j < len(fa):
            merged = _merge(fa[j], b[n])
            put([merged]) if id(fa[j]) in optional else out.append(merged)
        i, k = j + 1, n + 1
    return out


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places (i, j) of a common subsequence, in order: equal ends, between them what each side has once, and so on in the gaps; in
    a gap without such terms the first occurrence goes with the first, the second with the second. The time is about n log n a level
    of gaps, for sequences of any length."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        i, j, k, n = gaps.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i == j or k == n:
            continue
        na, nb = Counter(a[i:j]), Counter(b[k:n])
        once = {c for c, m in na.items() if m == 1 and nb.get(c) == 1}
        seen: Counter = Counter()
        place = {}
        for y in range(k, n):
            if not once or b[y] in once:
                place[b[y], seen[b[y]]] = y
                seen[b[y]] += 1
        seen.clear()
        met = []
        for x in range(i, j):
            if not once or a[x] in once:
                if (y := place.get((a[x], seen[a[x]]))) is not None:
                    met.append((x, y))
                seen[a[x]] += 1
        rising = _rising(met)
        out += rising
        if once:
            edges = [(i - 1, k - 1), *rising, (j, n)]
            gaps += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _rising(met: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs sorted by the first number in which the second rises too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for at, (_, y) in enumerate(met):
        length = bisect.bisect_left(tops, y)
        back.append(ends[length - 1] if length else -1)
        if length == len(tops):
            tops.append(y)
            ends.append(at)
        else:
            tops[length], ends[length] = y, at
    out = []
    at = ends[-1] if ends else -1
    while at >= 0:
        out.append(met[at])
        at = back[at]
    return out[::-1]


@dataclass
class Wrapper:
    """A template's union-free ``expression``, and what it says of the article: ``main`` is the path of the container that holds
    most of its slots' text (none: the pages have no text)."""

    main: tuple[str, ...] = ()
    expression: str = ""

    def dump(self) -> str:
        return json.dumps({"main": self.main})

    @staticmethod
    def load(text: str | None) -> "Wrapper":
        return Wrapper(tuple(json.loads(text)["main"] if text else ()))


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages: their token streams aligned one by one into an expression, and the container of its slots."""
    expression: list[Node] = []
    tree, n = Paths(), 0
    for page in pages:
        if not page:
            continue
        new = fold(stream(page, tree))
        if n:
            units = units_of(expression) | units_of(new)
            new = align(fold(expression, units), fold(new, units))
        expression = new
        n += 1
    return Wrapper(container(list(_leaves(expression)), n, tree), " ".join(x.show() for x in expression))


def container(leaves: list[Node], pages: int, tree: Paths) -> tuple[str, ...]:
    """The deepest container with MOST of the text that varies (one page: of all text) and isn't linked. If article or main
    elements hold a fifth of that text, only those are considered; what labels exclude isn't counted, unless that leaves nothing.
    Sums and tests run once over the tree of all paths, so the time doesn't grow with its depth."""
    name = [x.split(".", 1)[0] for x in tree.label]
    linked = tree.inherit(lambda p: name[p] == "a")
    text = [x for x in leaves if (x.slot or pages == 1) and not linked[x.path]] or leaves

    def held(some: list[Node]) -> list[int]:
        at: Counter = Counter()
        for x in some:
            at[x.path] += x.chars
        return tree.add_up(at)

    # in a table of leaves a label counts below what holds most of the text only, so that no ancestor of the article excludes it
    inside = held(text)
    least = 0.5 * inside[0]
    out = tree.inherit(lambda p: excluded(tree.label[p]) and (name[p] in OUTSIDE or inside[p] < least))
    kept = [x for x in text if not out[x.path]] or text
    mass = held(kept)
    seen = tree.inherit(lambda p: False)
    for x in kept:
        p = x.path
        while p and not seen[p]:
            seen[p] = True
            p = tree.parent[p]
    holders = [p for p in range(1, len(name)) if seen[p] and name[p] in BLOCK and name[p] not in INLINE_END_AT and name[p] not in PARTS]
    marked = [p for p in holders if name[p] in MAIN and mass[p] >= 0.2 * mass[0]]
    if marked:
        article = [p for p in marked if name[p] == "article"]
        return tree.labels(max(article or marked, key=lambda p: (mass[p], -tree.depth[p])))
    good = [p for p in holders if mass[p] >= MOST * mass[0]]
    return tree.labels(max(good, key=lambda p: (tree.depth[p], mass[p]), default=0))


def _leaves(nodes: list[Node]) -> Iterator[Node]:
    for x in nodes:
        if x.kind == "#":
            yield x
        yield from _leaves(x.inner)


def extract(page: str | None, wrapper: Wrapper) -> str:
    """The blocks of the article, white space turned into single spaces, joined by line feeds. A page that hasn't its template's
    container is taken as a template of its own."""
    if not page:
        return ""
    tree = Paths()
    seen = list(placed(tokens(page), tree))
    wanted = _wanted(tree, wrapper.main)
    if not any(t is not None and wanted[p] and t.strip() for _, p, t in seen):
        wanted = _wanted(tree, infer([page]).main)
    blocks: list[str] = []
    here: list[str] = []

    def end() -> None:
        if here:
            if text := _SPACE.sub(" ", "".join(here)).strip():
                blocks.append(text)
            here.clear()

    for _, path, text in seen:
        if text is None:
            end()
        elif wanted[path]:
            here.append(text)
    end()
    return "\n".join(blocks)


def _wanted(tree: Paths, main: tuple[str, ...]) -> list[bool]:
    """For every path of a page whether it is in the container and below nothing that labels exclude there."""
    n = len(tree.parent)
    agree, wanted = [0] * n, [not main] * n  # outer labels that a path shares with the container's
    for node in range(1, n):  # parents come first
        up, depth = tree.parent[node], tree.depth[node]
        same = agree[up] == depth - 1 and depth <= len(main) and main[depth - 1] == tree.label[node]
        agree[node] = agree[up] + same
        if agree[up] >= len(main):
            wanted[node] = wanted[up] and not excluded(tree.label[node])
        else:
            wanted[node] = bool(main) and agree[node] == len(main)
    return wanted


def with_host(pages: DataFrame, url: str = "url", out: str = "host") -> DataFrame:
    return pages.withColumn(out, F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)))


def _marked(html: str = "html"):
    return F.coalesce(F.col(html).rlike(r"(?i)<(article|main)[\s/>]"), F.lit(False))


#: Elements that a page is laid out by, each with its class, if it has one.
LAYOUT = r"(?i)<(?:article|aside|div|footer|form|header|main|nav|section|table)\b(?:[^<>]*?\bclass\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>]+))?"


def shape(html: Column) -> Column:
    """A hash of the different layout elements of a page and their classes (without digits), in any order and number: what pages of one
    template have in common."""
    mark = lambda x: F.concat(
        F.regexp_extract(x, r"^<(\w+)", 1), F.lit("."), F.regexp_replace(F.regexp_extract(x, r"(?s)\bclass\s*=\s*(.*)$", 1), r"[0-9\"']+", "")
    )
    found = F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(LAYOUT), F.lit(0)))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(found, mark))))


def _first(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, within salts first, so no task sees a whole group."""
    w = W.partitionBy(*by, F.pmod(F.col("h"), F.lit(SALTS * 4))).orderBy(*order)
    rows = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)
    return rows.withColumn("r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("r") <= n).drop("r")


def infer_wrappers(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(host, marked, shape, wrapper, expression) for every host, kind and shape among all pages: a wrapper from ``sample`` pages of it.

    A shape that one page alone has says nothing of what varies; such pages of a host share a wrapper, inferred from them
    first and other pages of the host and kind after them."""
    p = with_host(pages.select("url", F.col("html").cast("string").alias("html"))).where("html IS NOT NULL")
    p = p.select("host", "html", F.xxhash64("url", "html").alias("h"), _marked().alias("marked"), shape(F.col("html")).alias("shape"))
    kind, template = ["host", "marked"], ["host", "marked", "shape"]
    some = materialise(_first(p.select(*template, "h"), template, ["h"], sample).distinct())
    counted = some.groupBy(template).agg(F.count(F.lit(1)).alias("n"))
    rare = counted.where("n = 1").select(kind).distinct()
    rest = _first(some.join(counted, template).join(rare, kind), kind, ["n", "h"], sample).select(*kind, F.lit(None).cast("long").alias("shape"), "h")
    members = some.join(counted.where("n > 1").select(template), template).unionByName(rest)
    members = materialise(members.select(*kind, F.col("shape").alias("template"), "h"))
    keys = members.select(*kind, "h", "template")
    chosen = p.drop("shape").join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, [*kind, "h"])
    grouped = chosen.dropDuplicates([*kind, "template", "h"]).groupBy(*kind, "template").agg(F.sort_array(F.collect_list("html")).alias("htmls"))

    def each(htmls: pd.Series) -> pd.DataFrame:
        found = [infer(list(x)) for x in htmls]
        return pd.DataFrame({"wrapper": [w.dump() for w in found], "expression": [w.expression for w in found]}, dtype=object)

    inferred = F.pandas_udf(each, "wrapper string, expression string")("htmls")
    wrappers = materialise(grouped.select(*kind, "template", inferred.alias("w")).select(*kind, "template", "w.*"))
    of_page = counted.withColumn("template", F.when(F.col("n") > 1, F.col("shape"))).alias("c").join(
        wrappers.alias("w"), [F.col(f"c.{x}").eqNullSafe(F.col(f"w.{x}")) for x in (*kind, "template")]
    )
    return of_page.select(*[f"c.{x}" for x in template], "w.wrapper", "w.expression")


def main_text(pages: DataFrame, sample: int = SAMPLE_PAGES) -> DataFrame:
    """(page_id, url, text, host): the main text of every page by its template's wrapper.

    Pages of a host with article or main tags and those without, and those of different layout elements, have a wrapper each. The
    expression's slots tell the container; tags are a hint for it, labels only cut out parts below it. A page without its
    wrapper's container is a template of its own.
    Defined cases: null or empty html gives an empty text; a null or odd url has the host ''; repeated pages give repeated rows;
    no pages give no rows; further columns of ``pages`` are not passed on.
    """
    template = ["host", "marked", "shape"]
    wrappers = materialise(infer_wrappers(pages, sample).select(*template, "wrapper"))
    small = (wrappers.agg(F.sum(F.length("host") + F.length("wrapper") + 60)).first()[0] or 0) <= BROADCAST_BYTES
    p = with_host(pages.select("page_id", "url", F.col("html").cast("string").alias("html")))
    p = p.withColumn("marked", _marked()).withColumn("shape", shape(F.col("html")))
    if small:
        joined = p.join(F.broadcast(wrappers), template, "left")
    else:  # a template that a third of the pages have is spread over salts
        wrappers = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = p.join(wrappers, [*template, "salt"], "left")

    def apply(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Wrapper] = {}
        for pdf in batches:
            texts = []
            for page, w in zip(pdf["html"], pdf["wrapper"], strict=True):
                if len(known) > 1000:
                    known.clear()
                w = w or ""
                if w not in known:
                    known[w] = Wrapper.load(w)
                texts.append(extract(page, known[w]))
            yield pdf[["page_id", "url", "host"]].assign(text=texts)

    joined = joined.select("page_id", "url", "host", "html", "wrapper")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, host string, text string"
    return joined.mapInPandas(apply, schema)
