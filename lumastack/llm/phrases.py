"""Phrases of two and three words, mined level by level with double-array tries.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Three passes read it,
however many candidates there are:

1. words are counted for each language; those below ``min_count`` can be in no frequent phrase;
2. neighbours that are both frequent are runs of two words;
3. three words are a run where both of their pairs are frequent, so no frequent phrase is lost.

Frequent words and pairs are broadcast as bits (``Seen``), which let a few others through: these fall short later. Tasks add
up the runs they meet and deal them out by all their words. A task adds up its share in buckets; runs in buckets that reach
``min_count`` are its candidates. It builds a trie of them, moves the states of all runs from level to level at once and
counts the states that accept. These are the counts that everything after uses. No trie leaves its task.

A trie is a double array over the numbers of its own words: from state s the word c leads to base[s] + c if check there is
s. A trie has about ``MAX_PART`` candidates at most; more are dealt, by hash, to several. Pass 2 takes words as they come
when the frequent ones are more than ``MAX_WORDS``, which finds more runs and the same phrases. Words are compared by 64-bit
hashes that include their language; their strings come from pass 1.

Cases: a null or empty text has no words; a null language is ``und``; repeated rows count each time; phrases of equal score
and count go by their bytes; an empty table gives an empty result; a text of any length is one text, cut nowhere but at
pieces; columns other than text and lang are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import removed, shared_dir, stored
from .textops import LOWER, mix64, span_hashes, text_slices, word_spans

MAX_WORDS, MAX_PART, HELD, SALTS, LOOK, SLICE = 8_000_000, 2_000_000, 500_000, 32, 8192, 600_000
#: Words of the texts for each task that counts runs, which has at most as many rows: a position starts one run, and tasks add up.
SHARE = 2_000_000
#: Powers of two: the bits of ``Seen`` at most, and those that one task makes.
MOST_BITS, PIECE_BITS = 30, 20
#: Bytes between pieces, and those between words of a piece besides.
BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
GAP = BREAK.copy()
GAP[[9, 32]] = True


@dataclass
class Words:
    """The words of some texts end to end: hashes, whether the next one is in the same piece, and where they stand."""

    hashes: np.ndarray
    joined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    data: np.ndarray


def words_of(offsets: np.ndarray, data: np.ndarray, langs: np.ndarray) -> Words:
    """``langs`` holds a 64-bit key of each row's language."""
    data = LOWER[data]
    starts, ends, rows = word_spans(offsets, data, GAP)
    cuts = np.concatenate(([0], np.cumsum(BREAK[data], dtype=np.int64)))
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (cuts[ends[:-1]] == cuts[starts[1:]]) & (rows[1:] == rows[:-1])
    return Words(mix64(span_hashes(data, starts, ends) + langs[rows]), joined, starts, ends, rows, data)


def _language_keys(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    coded = column.dictionary_encode()
    keys = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return coded, np.array(keys, np.uint64)[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, pa.Array]]:
    for batch in batches:
        coded, keys = _language_keys(batch.column("lang"))
        for row, offsets, data in text_slices(batch.column("text"), SLICE):
            n = len(offsets) - 1
            yield words_of(offsets, data, keys[row : row + n]), coded.slice(row, n)


def _distinct(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct keys, by ascending key, and their sums."""
    order = np.argsort(keys)
    ascending = keys[order]
    first = np.flatnonzero(np.append(True, ascending[1:] != ascending[:-1]))[: len(keys)]
    return order[first], np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)


class _Sums:
    """Counts of runs of ``width`` words, added up in a task until they are ``HELD``, then passed on to ``shares`` tasks."""

    def __init__(self, width: int, shares: int):
        self.width, self.parts, self.held = width, [], 0
        self.bounds = np.array([-(-(p << 64) // shares) for p in range(1, shares)], np.uint64)

    def add(self, columns: list[np.ndarray]) -> None:
        self.parts.append([*columns, np.ones(len(columns[0]), np.int64)])
        self.held += len(columns[0])

    def merged(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)] if self.parts else [np.zeros(0, np.uint64)] * self.width + [np.zeros(0, np.int64)]
        first, total = _distinct(_joint(columns[:-1]), columns[-1])
        self.parts, self.held = [], 0
        return [*(c[first] for c in columns[:-1]), total]

    def full(self) -> bool:
        """Merge what is held; true if it stays large."""
        if self.held <= HELD:
            return False
        columns = self.merged()
        self.parts, self.held = [columns], len(columns[0])
        return self.held > HELD // 2

    def rows(self) -> pa.RecordBatch:
        """(share, runs): what is held, a row a share, by ranges of keys."""
        columns = self.merged()
        cuts = [0, *np.searchsorted(_joint(columns[:-1]), self.bounds).tolist(), len(columns[-1])]
        table = np.stack([c.view(np.uint64) for c in columns])
        own = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([table[:, cuts[i] : cuts[i + 1]].tobytes() for i in own], pa.binary())], ["share", "runs"])


def _joint(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0]
    for c in columns[1:]:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


def _rows(columns: list[np.ndarray]) -> pa.RecordBatch:
    """(h1, h2, h3, n); missing hashes are null."""
    arrays = [pa.array(c.view(np.int64)) for c in columns[:-1]]
    arrays += [pa.nulls(len(columns[-1]), pa.int64())] * (3 - len(arrays))
    return pa.RecordBatch.from_arrays([*arrays, pa.array(columns[-1])], ["h1", "h2", "h3", "n"])


_SUMS, _RUNS = "h1 long, h2 long, h3 long, n long", "share int, runs binary"


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of byte spans; bytes that are no UTF-8 are replaced."""
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    own = data[np.repeat(starts - offsets[:-1], ends - starts) + np.arange(offsets[-1])]
    out = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(own))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        out = pa.array([own[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())
    return out


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, hash, n) of distinct words, and the number of all words with a null word."""
    held, size, total = [], 0, {}

    def out() -> pa.RecordBatch:
        h, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        first, sums = _distinct(h, n)
        pick = pa.array(first)
        lang, word = (pa.concat_arrays([x[i] for x in held]).take(pick) for i in (2, 3))
        return pa.RecordBatch.from_arrays([lang, word, pa.array(h[first].view(np.int64)), pa.array(sums)], ["lang", "word", "hash", "n"])

    for words, langs in _slices(batches):
        if not len(words.hashes):
            continue
        langs = langs.cast(pa.string())
        for name, n in zip(langs.to_pylist(), np.bincount(words.rows, minlength=len(langs)).tolist(), strict=True):
            total[name] = total.get(name, 0) + n
        first, n = _distinct(words.hashes, np.ones(len(words.hashes), np.int64))
        held.append((words.hashes[first], n, langs.take(pa.array(words.rows[first])), _strings(words.data, words.starts[first], words.ends[first])))
        size += len(first)
        if size > HELD:
            yield out()
            held, size = [], 0
    if held:
        yield out()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "hash", "n"])


@dataclass
class Seen:
    """Two bits for each of some hashes: all of these pass, and one or two in a hundred of the others."""

    bits: np.ndarray
    power: int  # of two, the number of bits

    @staticmethod
    def places(hashes: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
        shift = np.uint64(64 - power)
        return (hashes >> shift).astype(np.int64), (mix64(hashes) >> shift).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, self.power):
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def _seen(rows: DataFrame, columns: list[str], n: int) -> Broadcast:
    """The ``Seen`` of ``n`` rows of hashes, made in pieces by tasks; only its bits reach the driver."""
    power = min(max((16 * n).bit_length(), PIECE_BITS), MOST_BITS)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in Seen.places(_joint([batch.column(c).to_numpy().view(np.uint64) for c in columns]), power):
                yield pa.RecordBatch.from_arrays([pa.array((at >> PIECE_BITS).astype(np.int32)), pa.array((at & (1 << PIECE_BITS) - 1).astype(np.int32))], ["piece", "at"])

    def piece(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << PIECE_BITS, np.uint8)
        bits[table.column("at").to_numpy()] = 1
        return pa.table({"piece": table.column("piece").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = rows.select(*columns).mapInArrow(places, "piece int, at int").groupBy("piece").applyInArrow(piece, "piece int, bits binary").toArrow()
    bits = np.zeros((1 << power - PIECE_BITS, 1 << PIECE_BITS - 3), np.uint8)
    for i, b in zip(made.column("piece").to_pylist(), made.column("bits"), strict=True):
        bits[i] = np.frombuffer(b.as_buffer(), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(Seen(bits.ravel(), power))


def _pairs(frequent: Broadcast | None, shares: int) -> Callable:
    """Two words that follow each other, both of them in ``frequent``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(2, shares)
        for words, _ in _slices(batches):
            h, good = words.hashes, words.joined
            if frequent is not None:
                known = frequent.value.has(h)
                good = good & known & np.append(known[1:], False)
            at = np.flatnonzero(good)
            sums.add([h[at], h[at + 1]])
            if sums.full():
                yield sums.rows()
        yield sums.rows()

    return task


def member(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places of values in an ascending table, -1 where they are not."""
    if not len(table):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return np.where(table[at] == values, at, -1)


@dataclass
class Trie:
    """A double array; states 1 to the number of words are the first words, others lie behind them."""

    words: np.ndarray  # ascending hashes
    numbers: np.ndarray  # of these words, the most frequent in candidates first, so that families lie close
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray  # number of the candidate that ends in a state, or -1

    def _codes(self, hashes: np.ndarray) -> np.ndarray:
        at = member(self.words, hashes)
        return np.where(at >= 0, self.numbers[at], -1) if len(self.words) else at

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that words lead to from others, or -1."""
        to = self.base[state].astype(np.int64) + code
        good = (to > 0) & (to < len(self.check))
        good[good] = self.check[to[good]] == state[good]
        return np.where(good, to, -1)

    def states(self, words: Words, levels: int = 3) -> Iterator[np.ndarray]:
        """For each level the state of every position after so many words from there, or -1."""
        code = self._codes(words.hashes)
        state = np.where(code >= 0, code + 1, -1)
        yield state
        for level in range(1, levels):
            last = len(state) - level
            after = np.full(len(state), -1)
            live = np.flatnonzero((state[: max(last, 0)] >= 0) & words.joined[level - 1 : level - 1 + max(last, 0)])
            live = live[code[live + level] >= 0]
            after[live] = self._step(state[live], code[live + level])
            state = after
            yield state

    def walked(self, columns: list[np.ndarray]) -> np.ndarray:
        """The state after all words of each run, or -1; ``columns`` holds their first words, their second ones and so on."""
        state = self._codes(columns[0])
        state = np.where(state >= 0, state + 1, -1)
        for column in columns[1:]:
            code = self._codes(column)
            live = np.flatnonzero((state >= 0) & (code >= 0))
            after = np.full(len(state), -1)
            after[live] = self._step(state[live], code[live])
            state = after
        return state


def _placed(base: np.ndarray, check: np.ndarray, parents: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Give the children (parent state, word number), sorted by both, their slots: the larger families first, by first fit."""
    cut = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
    sizes = np.diff(np.append(cut, len(parents)))
    slots, low = np.zeros(len(parents), np.int64), len(base)
    used = np.zeros(low + 2 * len(parents) + 2 * LOOK, bool)
    used[:low] = True
    top, full, last = low, low, low
    for f in np.argsort(-sizes, kind="stable")[: int((sizes > 1).sum())].tolist():
        rel = codes[cut[f] : cut[f] + sizes[f]]
        rel = (rel - rel[0]).tolist()
        while used[full]:
            full += 1
        spot = top
        for a in [*range(full, min(top, full + 2 * LOOK), LOOK), *range(max(last, full), top, LOOK)]:  # early holes, then from where the last family went
            if a + rel[-1] + LOOK > len(used):
                break
            taken = used[a : a + LOOK].copy()
            for r in rel[1:]:
                taken |= used[a + r : a + r + LOOK]
            at = int(taken.argmin())
            if not taken[at]:
                spot, last = a + at, a
                break
        if spot + rel[-1] + 2 * LOOK > len(used):
            used = np.append(used, np.zeros(rel[-1] + len(parents) + 2 * LOOK, bool))
        place = spot + np.array(rel)
        used[place] = True
        slots[cut[f] : cut[f] + sizes[f]] = place
        top = max(top, int(place[-1]) + 1)
    single = cut[sizes == 1]
    slots[single] = np.flatnonzero(~used)[: len(single)] if (~used).sum() >= len(single) else np.concatenate((np.flatnonzero(~used), len(used) + np.arange(len(single) - (~used).sum())))
    end = max(low, int(slots.max()) + 1)
    base, check = np.append(base, np.zeros(end - low, np.int32)), np.append(check, np.full(end - low, -1, np.int32))
    base[parents[cut]] = slots[cut] - codes[cut]
    check[slots] = parents
    return base, check, slots


def build_trie(candidates: np.ndarray, sizes: np.ndarray) -> Trie:
    """The trie of rows of up to three hashes, of which ``sizes`` count."""
    words, uses = np.unique(np.concatenate([candidates[sizes > i, i] for i in range(3)]), return_counts=True)
    numbers = np.empty(len(words), np.int32)
    numbers[np.argsort(-uses, kind="stable")] = np.arange(len(words))
    base, check = np.zeros(len(words) + 1, np.int32), np.zeros(len(words) + 1, np.int32)
    state = np.zeros(len(sizes), np.int64)
    ends = np.full(len(sizes), -1, np.int64)
    for level in range(3):
        on = np.flatnonzero(sizes > level)
        code = numbers[np.searchsorted(words, candidates[on, level])].astype(np.int64) if len(on) else np.zeros(0, np.int64)
        if level == 0:
            state[on] = code + 1
        elif len(on):
            key, back = np.unique(state[on] * (len(words) + 1) + code, return_inverse=True)
            base, check, slots = _placed(base, check, key // (len(words) + 1), key % (len(words) + 1))
            state[on] = slots[back]
        ends[sizes == level + 1] = state[sizes == level + 1]
    accepts = np.full(len(base), -1, np.int32)
    accepts[ends] = np.arange(len(sizes))
    return Trie(words, numbers, base, check, accepts)


def _triples(pairs: Broadcast, shares: int) -> Callable:
    """Three words that follow each other, both of whose pairs are in ``pairs``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(3, shares)
        for words, _ in _slices(batches):
            h, good = words.hashes, words.joined.copy()
            at = np.flatnonzero(good)
            good[at] = pairs.value.has(_joint([h[at], h[at + 1]]))
            at = np.flatnonzero(good[:-1] & good[1:])
            sums.add([h[at], h[at + 1], h[at + 2]])
            if sums.full():
                yield sums.rows()
        yield sums.rows()

    return task


def trie_counts(columns: list[np.ndarray], counts: np.ndarray, least: int) -> list[np.ndarray]:
    """The distinct runs whose counts sum to ``least`` or more, and the sums, by a trie of those that can: buckets of runs tell."""
    keys = _joint(columns)
    bucket = (keys & np.uint64((1 << len(keys).bit_length()) - 1)).astype(np.int64)  # low bits: the high ones tell shares
    live = np.flatnonzero(np.bincount(bucket, weights=counts)[bucket] >= least) if len(keys) else bucket
    columns, counts = [c[live] for c in columns], counts[live]
    first = np.unique(keys[live], return_index=True)[1]
    candidates = np.zeros((len(first), 3), np.uint64)
    for i, c in enumerate(columns):
        candidates[:, i] = c[first]
    trie = build_trie(candidates, np.full(len(first), len(columns)))
    total = np.bincount(trie.walked(columns), weights=counts, minlength=len(trie.accepts)).astype(np.int64)
    at = np.flatnonzero((total >= least) & (trie.accepts >= 0))
    return [*(candidates[trie.accepts[at], i] for i in range(len(columns))), total[at]]


def _counted(width: int, least: int, max_part: int) -> Callable:
    """The runs of ``width`` words that reach ``least``; all rows of a share are in one task, which has some millions of runs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b.as_buffer(), np.uint64).reshape(width + 1, -1) for batch in batches for b in batch.column("runs")]
        if not held:
            return
        table = np.concatenate(held, axis=1)
        held, (*hashes, counts) = None, table
        parts = -(-len(counts) // max_part)
        part = mix64(_joint(hashes)) % np.uint64(parts)
        for p in range(parts):
            own = part == p
            yield _rows(trie_counts([h[own] for h in hashes], counts[own].view(np.int64), least))

    return task


def _frequent(runs: DataFrame, width: int, least: int, shares: int, max_part: int) -> DataFrame:
    return runs.repartitionById(shares, F.col("share")).mapInArrow(_counted(width, least, max_part), _SUMS)


def phrases(docs: DataFrame, *, min_count: int = 10, top: int = 2000, max_words: int = MAX_WORDS, max_part: int = MAX_PART) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score."""
    spark = docs.sparkSession
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    paths = [shared_dir(spark) for _ in range(3)]

    words = texts.mapInArrow(_counted_words, "lang string, word string, hash long, n long")
    words = words.repartition("lang", "word", "hash").groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))  # tasks have added up what they met
    words = stored(words.where(F.col("word").isNull() | (F.col("n") >= min_count)), paths[0])
    known = words.where(F.col("word").isNotNull())
    n_known, total = known.count(), words.where(F.col("word").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARE))

    frequent = _seen(known, ["hash"], n_known) if n_known <= max_words else None
    pairs = stored(_frequent(texts.mapInArrow(_pairs(frequent, shares), _RUNS), 2, min_count, shares, max_part), paths[1])
    triples = texts.mapInArrow(_triples(_seen(pairs, ["h1", "h2"], pairs.count()), shares), _RUNS)
    found = pairs.unionByName(stored(_frequent(triples, 3, min_count, shares, max_part), paths[2]))
    out = stored(_ranked(found, words, top))
    removed(spark, *paths)
    return out


def _ranked(found: DataFrame, words: DataFrame, top: int) -> DataFrame:
    known = words.where(F.col("word").isNotNull())
    word = lambda i: known.select(F.col("hash").alias(f"h{i}"), F.col("word").alias(f"w{i}"), F.col("n").alias(f"n{i}"), F.col("lang").alias(f"lang{i}"))
    two = found.where(F.col("h3").isNull()).select("h1", "h2", F.col("n").alias("a"))
    three = found.where(F.col("h3").isNotNull()).select("h1", "h2", "h3", F.col("n").alias("a"))
    longer = three.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "a")
    longer = longer.groupBy("p.h1", "p.h2").agg(F.max("a").alias("longer"))
    two_kept = two.join(longer, ["h1", "h2"], "left").where(F.coalesce(100 * F.col("longer") < 50 * F.col("a"), F.lit(True))).drop("longer")
    pairs = two_kept.join(word(1), "h1").join(word(2), "h2").select(F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"))
    cut = "cast((cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0))) as long)"
    pairs = pairs.withColumn("score", F.expr(cut.format(l="l", r="r")))
    first, last = two.select("h1", "h2", F.col("a").alias("front")), two.select(F.col("h1").alias("h2"), F.col("h2").alias("h3"), F.col("a").alias("back"))
    triples = three.join(first, ["h1", "h2"]).join(last, ["h2", "h3"]).join(word(1), "h1").join(word(2), "h2").join(word(3), "h3")
    triples = triples.withColumns({"s1": F.expr(cut.format(l="n1", r="back")), "s2": F.expr(cut.format(l="front", r="n3"))})
    one = F.col("s1") <= F.col("s2")
    triples = triples.select(
        F.col("lang1").alias("lang"), F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(one, F.col("n1")).otherwise(F.col("front")).alias("l"), F.when(one, F.col("back")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = pairs.unionByName(triples).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("near", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("near") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.where(F.col("word").isNull()).select("lang", F.col("n").alias("all"))
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all").alias("n"), "score")
