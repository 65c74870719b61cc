"""Byte-level BPE as a finite-state transducer, and decoding as a stream."""

from __future__ import annotations

import base64
import codecs
import uuid
from array import array
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes that a vocabulary file may have to be sent to all tasks.
MAX_VOCABULARY = 64 << 20
#: A transducer forgets its steps, and a worker its pieces, beyond these numbers; both are only remembered work.
MAX_STEPS, MAX_PIECES, LONG_PIECE = 250_000, 200_000, 48
#: Characters of a text that are cut into pieces at once, and ids that are decoded at once.
TEXT_STEP, ID_STEP = 1 << 20, 1 << 16

#: Code points that count as letters or numbers only since versions of Unicode after the 16th, which the encoder that is to be
#: equalled follows. For it they are neither.
LATER = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)


def read_ranks(vocabulary: bytes) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line.strip())}


class Merges(NamedTuple):
    """A rank file compiled: the tokens by rank, the two parts of each token's last merge, and the tokens that merges never reach."""

    tokens: dict[int, bytes]
    left: dict[int, int]
    right: dict[int, int]
    unreached: frozenset[bytes]


def merged(ranks: dict[bytes, int], data: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
    """The parts of ``data`` after all merges, least rank and then leftmost first, and the last pair that was merged."""
    parts, last = [data[i : i + 1] for i in range(len(data))], None
    while True:
        best, where = -1, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], -1)
            if rank >= 0 and (best < 0 or rank < best):
                best, where = rank, i
        if where < 0:
            return parts, last
        last = (parts[where], parts[where + 1])
        parts[where : where + 2] = [last[0] + last[1]]


def compile_merges(ranks: dict[bytes, int]) -> Merges:
    lacking = [b for b in range(256) if bytes([b]) not in ranks]
    if lacking:
        raise ValueError(f"the vocabulary lacks {len(lacking)} of the 256 single bytes")
    left, right, unreached = {}, {}, set()
    for token, rank in ranks.items():
        if len(token) > 1:
            parts, last = merged(ranks, token)
            if len(parts) > 1:
                unreached.add(token)
                continue
            left[rank], right[rank] = ranks[last[0]], ranks[last[1]]
            if any(len(part) > 1 and ranks[part] > rank for part in last):
                raise ValueError(f"token {token!r} has a lower rank than a part of it")
    return Merges({rank: token for token, rank in ranks.items()}, left, right, frozenset(unreached))


class State:
    """The longest end of what was read that begins a token: a node of the vocabulary's trie. ``shorter`` is the state of the next shorter such
    end; ``endings`` are the tokens that end here, the longest first, with their lengths and the tokens that they are known to fit behind."""

    __slots__ = ("node", "steps", "shorter", "endings")

    def __init__(self, node: int) -> None:
        self.node, self.shorter = node, None
        self.steps: dict[int, State] = {}
        self.endings: tuple[tuple[int, int, dict[int, bool]], ...] = ()


class Transducer:
    """Merges compiled into a transducer from bytes to tokens, whose steps are determinised when they are first taken.

    The encoding of a piece without its last token is the encoding of what comes before it, and a sequence of tokens is an encoding
    exactly if every two neighbours are the encoding of their bytes. So each place of a piece has one encoding that ends there: the one
    whose last token may stand behind the encoding that ends where that token begins.

    No further token begins before the end that a state stands for. Each byte gives the last token of the encoding that ends behind it; a register holds those
    since the last one emitted. Tokens are emitted as soon as the encodings of all places at which a token may still begin agree on
    them; those places lie within the longest token's length.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.ranks = {token: rank for rank, token in merges.tokens.items()}
        # from here on a token is its rank plus one; 0 is none
        self.length = [0] * (max(merges.tokens) + 2)
        self.trie: dict[int, int] = {}  # node * 256 + byte -> node
        self.parent, self.byte, self.depth, self.token = (array("i", [0]) for _ in range(4))  # of a node
        for token, rank in self.ranks.items():
            self.length[rank + 1] = len(token)
            # a token that merges never reach stands only for a piece that equals it: it is not offered
            if token in merges.unreached:
                continue
            at = 0
            for byte in token:
                edge = at << 8 | byte
                if edge not in self.trie:
                    self.trie[edge] = len(self.parent)
                    self.parent.append(at)
                    self.byte.append(byte)
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(0)
                at = self.trie[edge]
            self.token[at] = rank + 1
        self.window = 8 * max(self.length)
        self._forget()

    def _forget(self) -> None:
        self.made: dict[int, State] = {}
        self.taken = 0
        self.start = self._state(0)

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two: no merge across them comes before the merges that make them.

        Taken back in time, merge by merge: parts x and y stand beside each other until the next of the two merges that take them up, at
        rank ``until``. Of merges of one rank the leftmost is first: one across comes after that of the left token, before that of the right.
        """
        tokens, ranks, left, right = self.merges.tokens, self.ranks, self.merges.left, self.merges.right
        x, y, until = a, b, len(self.length)
        while True:
            if ranks.get(tokens[x] + tokens[y], until) < until:
                return False
            # of both last merges the later one is taken back; single bytes have none
            made_x, made_y = x if x in right else -1, y if y in left else -1
            if made_x < 0 and made_y < 0:
                return True
            if made_x > made_y:
                x, until = right[x], made_x
            else:
                y, until = left[y], made_y + 1

    def _fits(self, last: int, token: int, known: dict[int, bool]) -> bool:
        self.taken += 1
        fits = known[last] = not last or self._neighbours(last - 1, token - 1)
        return fits

    def _state(self, node: int) -> State:
        if node not in self.made:
            state = self.made[node] = State(node)
            if node:
                parent = self.parent[node]
                state.shorter = self._step(self._state(parent).shorter, self.byte[node]) if parent else self.start
                own = ((self.token[node], self.depth[node], {}),) if self.token[node] else ()
                state.endings = own + state.shorter.endings
        return self.made[node]

    def _step(self, state: State, byte: int) -> State:
        if byte not in state.steps:
            down = self.trie.get(state.node << 8 | byte)
            self.taken += 1
            state.steps[byte] = self._state(down) if down is not None else self._step(state.shorter, byte) if state.node else state
        return state.steps[byte]

    def _back(self, register: list[int], at: int) -> list[int]:
        """The places between the tokens of the encoding that ends ``at``, from there back to the register's begin."""
        length, places = self.length, [at]
        while at:
            at -= length[register[at]]
            places.append(at)
        return places

    def _agreed(self, register: list[int], state: State) -> int:
        """The last place that the encodings of all places at which a token may still begin go through."""
        here, common = len(register) - 1, None
        while True:
            places = set(self._back(register, here - self.depth[state.node]))
            common = places if common is None else common & places
            if not state.node:
                return max(common)
            state = state.shorter

    def _read(self, state: State, piece: bytes, register: list[int]) -> State:
        """Read bytes on from a state; the register gets the last token of the encoding that ends behind each."""
        at = len(register)
        for byte in piece:
            state = state.steps.get(byte) or self._step(state, byte)
            for token, size, known in state.endings:
                last = register[at - size]
                fits = known.get(last)
                if self._fits(last, token, known) if fits is None else fits:
                    register.append(token)
                    at += 1
                    break
        return state

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece of text."""
        if piece in self.merges.unreached:
            return [self.ranks[piece]]
        if self.taken >= MAX_STEPS:
            self._forget()
        out: list[int] = []
        register = [0]
        if len(piece) <= self.window:
            self._read(self.start, piece, register)
        else:
            state = self.start
            for at in range(0, len(piece), self.window):
                state = self._read(state, piece[at : at + self.window], register)
                cut = self._agreed(register, state)
                out += [register[p] - 1 for p in reversed(self._back(register, cut)[:-1])]
                del register[:cut]
        rest, at, length = [], len(register) - 1, self.length
        while at:
            token = register[at]
            rest.append(token - 1)
            at -= length[token]
        rest.reverse()
        return out + rest if out else rest


class Later(Exception):
    """A piece holds characters that the plain pattern may have put into the wrong class."""


class Pieces(dict):
    """The ids of pieces, as int32 bytes; short pieces are remembered, up to a number."""

    def __init__(self, transducer: Transducer, later) -> None:
        super().__init__()
        self.transducer, self.later = transducer, later

    def encoded(self, piece: str) -> bytes:
        return array("i", self.transducer.encode(piece.encode("utf-8", "surrogatepass"))).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if self.later.search(piece):
            raise Later
        ids = self.encoded(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Texts to ids: pieces by a pattern, each through the transducer."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        import regex

        self.pattern = regex.compile(pattern)
        self.later = regex.compile(f"[{LATER}]")
        classes = {r"[^\s\p{L}\p{N}]": rf"[[^\s\p{{L}}\p{{N}}]||[{LATER}]]", r"\p{L}": rf"[\p{{L}}--[{LATER}]]", r"\p{N}": rf"[\p{{N}}--[{LATER}]]"}
        self.exact = regex.compile(regex.sub("|".join(map(regex.escape, classes)), lambda m: classes[m[0]], pattern), regex.V1)
        self.pieces = Pieces(Transducer(merges), self.later)

    @staticmethod
    def _cut(text: str, pattern) -> Iterator[list[str]]:
        if len(text) <= TEXT_STEP:
            yield pattern.findall(text)
            return
        found = (m[0] for m in pattern.finditer(text))
        while some := list(islice(found, TEXT_STEP // 8)):
            yield some

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.int32)
        try:
            ids = b"".join([b"".join(map(self.pieces.__getitem__, some)) for some in self._cut(text, self.pattern)])
        except Later:
            ids = b"".join([b"".join(map(self.pieces.encoded, some)) for some in self._cut(text, self.exact)])
        return np.frombuffer(ids, dtype=np.int32)


class StreamDecoder:
    """Ids to text as they come: bytes go through an incremental UTF-8 state machine, which holds back a character's bytes until its last;
    what is no UTF-8 becomes U+FFFD. ``tokens`` has each token's bytes at its rank."""

    def __init__(self, tokens: pa.LargeBinaryArray) -> None:
        self.tokens = tokens
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: pa.Array, final: bool = False) -> str:
        found = self.tokens.take(ids)
        if found.null_count:
            raise ValueError("an id is not in the vocabulary")
        ends = np.frombuffer(found.buffers()[1], dtype=np.int64)[found.offset : found.offset + len(found) + 1]
        data = found.buffers()[2]
        return self.machine.decode(b"" if data is None else memoryview(data)[ends[0] : ends[-1]], final)


def token_array(tokens: dict[int, bytes]) -> pa.LargeBinaryArray:
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_binary())


_encoders: dict[str, Encoder] = {}


def _encoder(sent: Broadcast, pattern: str) -> Encoder:
    """One a worker process and vocabulary: its steps and pieces serve all of the worker's tasks."""
    merges, name = sent.value
    key = f"{name} {pattern}"
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(merges, pattern)
    return _encoders[key]


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The ranks of a file that the driver can read, if its size allows to send them to all tasks."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY} bytes")
    return read_ranks(data)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids (array<int>) of every whole text: each match of ``pattern`` encoded by itself, without special tokens.

    ``vocabulary`` is a rank file; the driver compiles its merges once and sends them to the tasks. Defined cases: null and empty texts
    have no ids (an empty array); rows are encoded one by one, so repeated ones are alike and no rows give none; long texts are cut
    into pieces step by step and long pieces take time in proportion to their length; a column called ``out`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast((compile_merges(read_vocabulary(vocabulary)), uuid.uuid4().hex))

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _encoder(sent, pattern)
        for texts in batches:
            rows = [own.encode(t.as_py()) for t in texts]
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
            values = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
            if ends[-1] >= 2**31:
                raise ValueError("a batch of texts has over two billion ids: lower spark.sql.execution.arrow.maxRecordsPerBatch")
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))

    return docs.withColumn(out, F.arrow_udf(ids, "array<int>")(F.col(text)))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of every row's ids. Null is an empty text, an id that isn't in the vocabulary an error; bytes that are
    no UTF-8 become U+FFFD."""
    sent = docs.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_vocabulary(vocabulary).items()})

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = token_array(sent.value)
        for rows in batches:
            done = []
            for row in rows:
                machine, row = StreamDecoder(tokens), row.values
                n = 0 if row is None else len(row)
                done.append("".join([machine.feed(row[i : i + ID_STEP], i + ID_STEP >= n) for i in range(0, n, ID_STEP)]))
            yield pa.array(done, pa.string())

    return docs.withColumn(out, F.arrow_udf(texts, "string")(F.col(ids)))
