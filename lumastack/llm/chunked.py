"""Encoding whole texts through a bounded table of their space-separated chunks.

The tokenizers' split pattern always breaks before a space that follows or precedes a visible character, so a text's ids
are those of its first chunk and of each later chunk with its leading space. Texts with a space between two white-space
characters, where that does not hold, are encoded whole. A group of texts is split and its chunks are numbered by Arrow;
Python sees each different chunk of a group once, and the encoder each chunk once for as long as the table keeps it: a full
table drops the chunks that it met in one group only.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES, STRINGS = 1_200_000, 60_000


def text_groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) with a bounded number of bytes together, one text at least; nulls are empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    n, at = len(texts), 0
    ends = np.concatenate(([0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))))
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + BATCH_BYTES, "right")) - 1)
        yield at, texts.slice(at, stop - at)
        at = stop


class ChunkEncoder:
    """``encode`` maps strings to id sequences, one each."""

    def __init__(self, encode: Callable[[list[str]], list[Sequence[int]]], dtype: str, limit: int = 650_000) -> None:
        self.encode, self.dtype, self.limit = encode, np.dtype(dtype), limit
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, self.dtype), np.zeros(1, np.int64)
        self.opens, self.closes = np.zeros(0, bool), np.zeros(0, bool)  # chunks that are empty or have white space at that end
        self.met = np.zeros(0, np.int32)  # in how many groups

    def _shrink(self) -> None:
        """Drop the chunks that only one group had, and more of the rare ones if that leaves more than half of the table."""
        least = 2
        while (self.met >= least).sum() > self.limit // 2:
            least *= 2
        keep = np.flatnonzero(self.met >= least)
        chunks, width = list(self.place), np.diff(self.ends)[keep]
        ends = np.concatenate(([0], np.cumsum(width)))
        self.ids = self.ids[np.repeat(self.ends[keep] - ends[:-1], width) + np.arange(ends[-1])]
        self.ends, self.opens, self.closes, self.met = ends, self.opens[keep], self.closes[keep], self.met[keep] // 2
        self.place = {chunks[i]: n for n, i in enumerate(keep.tolist())}

    def known(self, chunk: str) -> np.ndarray | None:
        """The ids of a chunk with its leading space, if the table has them."""
        i = self.place.get(chunk)
        return None if i is None else self.ids[self.ends[i] : self.ends[i + 1]]

    def _flat(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        gc.disable()  # many lists and no cycles: the collector would only walk them again and again
        try:
            for at in range(0, len(strings), STRINGS):
                found = self.encode(strings[at : at + STRINGS])
                ids.append(np.array([i for x in found for i in x], self.dtype))
                sizes.append(np.array([len(x) for x in found], np.int64))
        finally:
            gc.enable()
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, self.dtype), np.zeros(0, np.int64))

    def _places(self, chunks: list[str]) -> np.ndarray:
        """The rows of the table that hold ``chunks``, which all differ."""
        at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        if len(self.place) and len(self.place) + len(new) > self.limit:
            self._shrink()
            at = np.fromiter(map(self.place.get, chunks, repeat(-1)), np.int64, len(chunks))
            new = np.flatnonzero(at < 0)
        if len(new):
            words = [chunks[i] for i in new.tolist()]
            ids, sizes = self._flat([" " + w for w in words])
            at[new] = np.arange(len(self.place), len(self.place) + len(new))
            self.place.update(zip(words, at[new].tolist(), strict=True))
            self.ids, self.ends = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
            self.opens = np.concatenate((self.opens, [not w or w[0].isspace() for w in words]))
            self.closes = np.concatenate((self.closes, [not w or w[-1].isspace() for w in words]))
            self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))
        self.met[at] += 1
        return at

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and the offsets of the texts."""
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        coded = lists.flatten().dictionary_encode()
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        at = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        # texts with a space between two white-space characters
        seam = self.closes[at[:-1]] & self.opens[at[1:]]
        seam[first[1:-1] - 1] = False
        odd = np.unique(np.searchsorted(first, np.flatnonzero(seam), "right") - 1)
        # first chunks have no leading space, and odd texts are whole: both are encoded now, behind the table
        heads = coded.dictionary.take(coded.indices.take(pa.array(first[:-1]))).to_pylist()
        for row, text in zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist(), strict=True):
            heads[row] = text
        ids, sizes = self._flat(heads)
        table, starts = np.concatenate((self.ids, ids)), np.concatenate((self.ends, self.ends[-1] + np.cumsum(sizes)))
        at[first[:-1]] = len(self.place) + np.arange(len(heads))
        width = starts[at + 1] - starts[at]
        for row in odd.tolist():
            width[first[row] + 1 : first[row + 1]] = 0
        total = np.concatenate(([0], np.cumsum(width)))
        return table[np.repeat(starts[at] - total[:-1], width) + np.arange(total[-1])], total[first]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The bytes of each text's ids."""
        ids, cuts = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
