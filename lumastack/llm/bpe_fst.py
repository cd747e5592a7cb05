"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the merges' result on its bytes exactly if each two neighbours are what merging their joint bytes
gives. So a nondeterministic transducer may guess every token end and is checked pair by pair. Its determinised form has
states made of hypotheses (last token, place in the trie of tokens, tokens not yet emitted), one for each possible start
of the unfinished token; a step advances them by a byte, drops dead ones, and emits what all that live agree on. The
lookahead is bounded by the longest token. States and steps are made when first met and kept, up to a limit, as in lazy
automata; past the limit they are made anew.

Two tokens are compared along the seam: on either side the pieces at the seam grow by their own merges, in rank order,
and the pair is broken if a merge across the seam comes first.

Cases: a null or empty text has no ids and decodes to nothing; texts of any length run in linear time; repeated rows and
ties give equal rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunked import ChunkEncoder, text_groups

NEVER = 1 << 60
STATES = 1_500_000
#: Tables of a task whose worker serves other jobs too.
TASK_STATES, TASK_CHUNKS = 120_000, 80_000


def read_ranks(text: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line.strip())}


def merged(ranks: dict[bytes, int], data: bytes, stop: int = 1) -> list[bytes]:
    """The plain merge loop; used for single tokens, of which it gives the last split, and in tests."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > stop:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], NEVER))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    def __init__(self, ranks: dict[bytes, int], limit: int = STATES) -> None:
        self.ranks, self.limit = ranks, limit
        self.of = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token = [-1]
        for t, i in ranks.items():
            node = 0
            for c in t:
                node = self.child.setdefault(node << 8 | c, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
            self.token[node] = i
        self.edges: dict[int, tuple[list, list]] = {}
        self.fits: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.steps: dict[int, tuple[int, tuple]] = {}
        self.tails: dict[int, tuple] = {}
        self._state(((-1, 0, ()),))

    def _state(self, hyps: tuple) -> int:
        if hyps not in self.ids:
            self.ids[hyps] = len(self.states)
            self.states.append(hyps)
        return self.ids[hyps]

    def _spines(self, t: int) -> tuple[list, list]:
        """The pieces of a token at its left and at its right end, from one byte to all of it, and when each is absorbed."""
        if t not in self.edges:
            data = self.of[t]
            if len(data) == 1:
                self.edges[t] = [(data, NEVER)], [(data, NEVER)]
            else:
                split = merged(self.ranks, data, 2)
                if len(split) != 2 or any(x not in self.ranks for x in split):
                    self.edges[t] = [], []  # no merge makes it
                else:
                    left, right = (self._spines(self.ranks[x]) for x in split)
                    top = [(data, NEVER)]
                    grow = lambda side: [*side[:-1], (side[-1][0], t)]
                    self.edges[t] = (grow(left[0]) + top, grow(right[1]) + top) if left[0] and right[1] else ([], [])
        return self.edges[t]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b gives a and b."""
        key = a << 20 | b
        if key not in self.fits:
            left, right = self._spines(a)[1], self._spines(b)[0]
            i = j = 0
            good = bool(left and right)
            while good:
                (x, when_x), (y, when_y) = left[i], right[j]
                cross = self.ranks.get(x + y, NEVER)
                if cross < when_x and cross <= when_y:
                    good = False
                elif when_x == when_y == NEVER:
                    break
                elif when_x <= when_y:
                    i += 1
                else:
                    j += 1
            if len(self.fits) > min(2_000_000, 2 * self.limit):
                self.fits.clear()
            self.fits[key] = good
        return self.fits[key]

    def _step(self, state: int, byte: int) -> tuple[int, tuple]:
        alive = []
        for last, node, rest in self.states[state]:
            node = self.child.get(node << 8 | byte)
            if node is None:
                continue
            if self.child_of(node):
                alive.append((last, node, rest))
            t = self.token[node]
            if t >= 0 and (self.compatible(last, t) if last >= 0 else bool(self._spines(t)[0])):
                alive.append((t, 0, (*rest, t)))
        first = alive[0][2]
        n = len(first)
        for _, _, rest in alive[1:]:
            n = min(n, len(rest))
            while first[:n] != rest[:n]:
                n -= 1
        out = self._state(tuple((last, node, rest[n:]) for last, node, rest in alive)), first[:n]
        self.steps[state << 8 | byte] = out
        return out

    def child_of(self, node: int) -> bool:
        """Whether a longer token goes on from here."""
        if not hasattr(self, "_inner"):
            self._inner = {k >> 8 for k in self.child}
        return node in self._inner

    def encode(self, data: bytes) -> list[int]:
        """The ids of one piece of text."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(self.steps) > self.limit:
            self._clear()
        state, out = 0, []
        for byte in data:
            known = self.steps.get(state << 8 | byte)
            if known is None and len(self.steps) > self.limit:  # a long piece alone may fill the tables
                here = self.states[state]
                self._clear()
                state = self._state(here)
            state, emitted = known if known is not None else self._step(state, byte)
            if emitted:
                out += emitted
        if state not in self.tails:
            self.tails[state] = next(rest for _, node, rest in self.states[state] if node == 0)
        out += self.tails[state]
        return out


# The lengths that lead bytes announce and the bounds of second bytes, as in the UTF-8 definition (fixed values).
_LEADS = [(0x00, 0x7F, 1), (0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)]
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def _machine() -> dict[tuple[int, int], int]:
    """(state, byte) -> state. States: 0 between characters, n > 0 that many more bytes, 256 + lead after a bounded lead."""
    table = {}
    for lo, hi, n in _LEADS:
        for b in range(lo, hi + 1):
            table[0, b] = 256 + b if b in _SECOND else n - 1
    for n in (1, 2, 3):
        for b in range(0x80, 0xC0):
            table[n, b] = n - 1
    for lead, (lo, hi) in _SECOND.items():
        for b in range(lo, hi + 1):
            table[256 + lead, b] = (2 if lead < 0xF0 else 3) - 1
    return table


class StreamDecoder:
    """Decodes ids as they come. Bytes of an unfinished character wait; the state machine steps once for each kind of token."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        self.tokens, self.machine, self.after = tokens, _machine(), {}
        self.state, self.waiting = 0, b""

    def _after(self, state: int, token: int) -> tuple[int, int]:
        """The state after a token and how many of its bytes stay unfinished (all and more: -1)."""
        key = state << 32 | token
        if key not in self.after:
            data, done = self.tokens[token], -1
            for i, b in enumerate(data):
                state = self.machine.get((state, b), self.machine.get((0, b), 0))
                if state == 0:
                    done = i + 1
            self.after[key] = state, -1 if done < 0 else len(data) - done
        return self.after[key]

    def feed(self, ids: list[int]) -> bytes:
        """The bytes of all characters that are complete by now."""
        data = self.waiting + b"".join(map(self.tokens.__getitem__, ids))
        if data and data[-1] < 0x80:
            self.state, self.waiting = 0, b""
            return data
        keep = len(self.waiting)
        for t in ids:
            self.state, left = self._after(self.state, t)
            keep = keep + len(self.tokens[t]) if left < 0 else left
        cut = len(data) - keep if self.state else len(data)
        self.waiting = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        """What is left, an unfinished character."""
        out, self.waiting, self.state = self.waiting, b"", 0
        return out


_made: dict[str, tuple[Transducer, ChunkEncoder]] = {}


def made(ranks_text: str, pattern: str, steps: int = STATES, chunks: int = 800_000) -> tuple[Transducer, ChunkEncoder]:
    """A transducer and a chunk cache of bounded sizes."""
    import regex

    fst = Transducer(read_ranks(ranks_text), steps)
    split = regex.compile(pattern).findall
    return fst, ChunkEncoder(lambda texts: [[i for piece in split(x) for i in fst.encode(piece.encode())] for x in texts], "<u4", chunks)


def encoder(ranks_text: str, pattern: str) -> tuple[Transducer, ChunkEncoder]:
    """One large transducer and cache for each Python worker, kept between its tasks."""
    key = hashlib.blake2b((ranks_text + pattern).encode()).hexdigest()
    if key not in _made:
        _made[key] = made(ranks_text, pattern)
    return _made[key]


def _coded(ranks: str, pattern: str, block: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks) as f:
            fst, chunks = encoder(f.read(), pattern)
        decoder = StreamDecoder(fst.of)
        for batch in batches:
            for row, texts in text_groups(batch):
                counts, id_hashes, byte_hashes = [], [], []
                every, cuts = chunks.encode_column(texts)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    h = hashlib.sha256()
                    for at in range(a, b, block):
                        h.update(decoder.feed(every[at : min(at + block, b)].tolist()))
                    h.update(decoder.close())
                    counts.append(b - a)
                    id_hashes.append(hashlib.sha256(every[a:b]).hexdigest())
                    byte_hashes.append(h.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(texts)), pa.array(counts, pa.int64()), pa.array(id_hashes), pa.array(byte_hashes)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return task


def code_digests(docs: DataFrame, ranks: str, pattern: str, *, block: int = 4096) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and then decoded in blocks of ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_coded(ranks, pattern, block), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(ranks: str, pattern: str) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks) as f:  # small caches of this task's own: other jobs' tasks follow in the same worker
            _, chunks = made(f.read(), pattern, TASK_STATES, TASK_CHUNKS)
        pa.default_memory_pool().release_unused()  # what earlier tasks of this worker held
        for batch in batches:
            for row, texts in text_groups(batch):
                ids, cuts = chunks.encode_column(texts)
                column = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
                part = batch.slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, column], [*part.schema.names, "ids"])

    return task


def encode(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with a column ``ids`` (array of int) for its column ``text``; an ``ids`` column it has is replaced."""
    rest = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(*rest, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    out = rows.mapInArrow(_encoded(ranks, pattern), f"{schema}, ids array<int>")
    return out.select(*rest, F.col("text").alias(text), "ids")


def _decoded(ranks: str, block: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(ranks) as f:
            decoder = StreamDecoder({i: t for t, i in read_ranks(f.read()).items()})
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                ids = ids.values.to_numpy() if ids.is_valid else np.zeros(0, int)
                parts = [decoder.feed(ids[at : at + block].tolist()) for at in range(0, len(ids), block)] + [decoder.close()]
                out.append("".join(x.decode("utf-8", "replace") for x in parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "decoded"])

    return task


def decode(coded: DataFrame, ranks: str, *, block: int = 4096) -> DataFrame:
    """``coded`` with a column ``decoded`` for its column ``ids``."""
    coded = coded.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(_decoded(ranks, block), f"{schema}, decoded string")
