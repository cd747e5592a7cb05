"""Token ids in length-delimited binary records with masked checksums, and a separate offset index.

A shard is a file of records, in the order of its rows. A record is
    length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), payload, masked CRC-32 of the payload (4), 0x0A,
all little-endian; a payload is a key flag (1 byte, 0: the key is null), the key (8 bytes) and the ids, 2 bytes each if
the vocabulary has at most 65,536 ids and 4 otherwise. A checksum c is masked as rotate-right(c, 15) + 0xA282EAD8, so that
checksums of data that hold checksums stay sound. Shards are written by Spark's committing text writer (the final 0x0A is
its line end): a lost executor's attempt leaves nothing behind. The index is a Parquet table of (shard, offset, length,
key, n_tokens), from which any order of reading can be drawn without scanning shards.

Cases: a null text is empty; an empty text is a record of its end id alone; repeated rows and ties in the key each give a
record, in the order of their texts' hashes; a null key is kept as null and sorts first; an empty table gives an empty
index. A text with an added token of the tokenizer, such as <|endoftext|>, has that token's id there, as the library gives
it. One record, of a text however long, is the work of one task, which reads a shard at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunked import ChunkEncoder, text_groups
from .scratch import ORDER, first_keys, keyed, part_of, prefix_of_parts, removed, shared_dir, stored

SHARD_BYTES = 16 << 20
_encoders: dict = {}


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at ``at`` and the place of the next one; raises on any damage."""
    length = data[at : at + 8]
    (n,) = struct.unpack("<Q", length)
    if masked(zlib.crc32(length)) != struct.unpack("<I", data[at + 8 : at + 12])[0]:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or masked(zlib.crc32(payload)) != struct.unpack("<I", data[at + 12 + n : at + 16 + n])[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + 17 + n


_MARKED = re.compile(r"([^\W\d_]+)([^\w\s']*)")


def _pieces(body: str) -> list[tuple[str, str]] | None:
    """Letters and the marks behind them of each line of a chunk, if there is nothing else."""
    out = []
    for line in body.split("\n"):
        m = _MARKED.fullmatch(line)
        if not m or not m[1].isalpha():
            return None
        out.append(m.groups())
    return out


class _Encoder(ChunkEncoder):
    """The tokenizers library over chunks; texts that hold an added token go through it whole.

    A space and letters, marks behind them, and a line end before letters are pieces of their own in the split pattern. Letters
    of such chunks go to the library's model as words that are split already, marks and all other chunks to the whole tokenizer.
    """

    def __init__(self, tokenizer, width: str) -> None:
        super().__init__(self._listed, width)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.added = [a.content for a in tokenizer.get_added_tokens_decoder().values()]
        # the byte-level alphabet: visible Latin-1 bytes stand for themselves, the others follow from U+0100 on
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.table = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.marks: dict[str, list[int]] = {"": []}

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _letters(self, words: list[tuple[str, bool]]) -> list[list[int]]:
        """The ids of words of letters alone, with a leading space or without."""
        table, tokenize = self.table, self.model.tokenize
        heads = ("", table[32])
        texts = [heads[lead] + (w if w.isascii() else w.encode().decode("latin-1").translate(table)) for w, lead in words]
        return [[t.id for t in tokenize(x)] for x in texts]

    def _listed(self, strings: list[str]) -> list[list[int]]:
        out: list = [None] * len(strings)
        plain, split, rest = [], [], []
        for i, x in enumerate(strings):
            lead = x[:1] == " "
            body = x[1:] if lead else x
            if body.isalpha():
                plain.append((i, (body, lead)))
            elif pieces := _pieces(body):
                split.append((i, lead, pieces))
            else:
                rest.append(i)
        for (i, _), ids in zip(plain, self._letters([x for _, x in plain]), strict=True):
            out[i] = ids
        if len(self.marks) > 100_000:
            self.marks = {"": []}
        fresh = list({marks for _, _, pieces in split for _, marks in pieces}.union("\n") - self.marks.keys())
        self.marks.update(zip(fresh, self._whole(fresh), strict=True))
        words = {(word, lead and not n) for _, lead, pieces in split for n, (word, _) in enumerate(pieces)}
        met = {x: known.tolist() for x in words if x[1] and (known := self.known(x[0])) is not None}
        met |= {x: out[i] for i, x in plain if x in words}
        new = list(words - met.keys())
        met.update(zip(new, self._letters(new), strict=True))
        for i, lead, pieces in split:
            ids: list[int] = []
            for n, (word, marks) in enumerate(pieces):
                ids = ids + (self.marks["\n"] if n else []) + met[word, lead and not n] + self.marks[marks]
            out[i] = ids
        for i, ids in zip(rest, self._whole([strings[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros(len(texts), bool)
        for a in self.added:
            held |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        if not held.any():
            return super().encode_column(texts)
        ids, cuts = super().encode_column(pc.if_else(pa.array(held), "", texts))
        parts = np.split(ids, cuts[1:-1])
        for i in np.flatnonzero(held).tolist():
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.dtype)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))


def tokenizer_encoder(path: str, width: str) -> ChunkEncoder:
    """The tokenizers library's encoder of the file at ``path``; one for each Python worker."""
    if (path, width) not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        pa.set_memory_pool(pa.system_memory_pool())  # gives large blocks back at once
        _encoders[path, width] = _Encoder(Tokenizer.from_file(path), width)
    return _encoders[path, width]


def forget() -> None:
    """Free the memory of a worker that has encoded before."""
    _encoders.clear()


def _framed(path: str, width: str, end_id: int, heads: list[tuple]) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer_encoder(path, width)
        end = np.array([end_id], width).tobytes()
        for batch in batches:
            for row, texts in text_groups(batch):
                keys = [batch.column(c).slice(row, len(texts)) for c in ORDER]
                ids, cuts = encoder.encode_column(texts)
                records, parts = [], []
                for key, a, b in zip(zip(*(k.to_pylist() for k in keys), strict=True), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    records.append(frame(struct.pack("<Bq", *key[:2]) + ids[a:b].tobytes() + end))
                    parts.append(part_of(heads, key))
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *keys, pa.array(records, pa.binary())], ["part", *ORDER, "value"])
            pa.default_memory_pool().release_unused()

    return task


def write_records(docs: DataFrame, out: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", vocabulary: int = 50_257, end_id: int = 0, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> None:
    """Encode ``text`` and write shards under ``out`` in ascending order of ``key``; part numbers give the shards' order.

    Keys with text hashes are cut into ranges first, so that a key with many rows is split as well; then texts are encoded
    where they are read, and their records, not the texts, are dealt out. Without ``shards``, there is one for each
    ``shard_bytes`` bytes of text: a reading task holds a few copies of one, so executors with more memory take larger ones.
    """
    width = "<u2" if vocabulary <= 65_536 else "<u4"
    rows = keyed(docs, key, text)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text") + 8).alias("n")).first()["n"] or 0
        shards = max(1, -(-size // shard_bytes))
    heads = first_keys(rows, shards) or [(False, 0, 0)]
    coded = rows.select(*ORDER, "text").mapInArrow(_framed(tokenizer, width, end_id, heads), "part int, known boolean, id long, tie long, value binary")
    dealt = coded.repartitionById(len(heads), "part").sortWithinPartitions(*ORDER)
    dealt.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(out)


def _scanned(width: str) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                at, start, rows = 0, 0, []
                while at < len(data):
                    payload, nxt = unframe(data, at)
                    known, key = struct.unpack("<Bq", payload[:9])
                    ids = np.frombuffer(payload[9:], width)
                    rows.append((shard, at, len(payload), key if known else None, len(ids), start, zlib.crc32(ids.astype("<u4").tobytes())))
                    start, at = start + len(ids), nxt
                if rows:
                    names = ["shard", "offset", "length", "key", "n_tokens", "start", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    return task


def _shards(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content").where(F.length("content") > 0)


def scan_records(spark: SparkSession, path: str, *, vocabulary: int = 50_257) -> DataFrame:
    """Read all shards and check every record: (shard, offset, length, key, n_tokens, start in the shard, ids_crc32)."""
    width = "<u2" if vocabulary <= 65_536 else "<u4"
    return _shards(spark, path).mapInArrow(_scanned(width), "shard long, offset long, length long, key long, n_tokens long, start long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index: str, *, vocabulary: int = 50_257) -> DataFrame:
    """Write the offset index of the shards at ``path``; ``start`` in it counts from the first record of all."""
    kept = shared_dir(spark)
    rows = stored(scan_records(spark, path, vocabulary=vocabulary), kept)
    before = prefix_of_parts(rows.groupBy(F.col("shard").alias("_part")).agg(F.sum("n_tokens").alias("_sum"))).withColumnRenamed("_part", "shard")
    out = stored(rows.join(before, "shard").withColumn("start", F.col("start") + F.col("_before")).drop("_before"), index)
    removed(spark, kept)
    return out


def _picked(width: str) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                rows = []
                for x in wanted:
                    payload, _ = unframe(data, x["offset"])
                    rows.append((x["place"], x["key"], np.frombuffer(payload[9:], width).astype(np.int64).tolist()))
                p, k, ids = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["place", "key", "ids"])

    return task


def read_picked(spark: SparkSession, path: str, picks: DataFrame, *, vocabulary: int = 50_257) -> DataFrame:
    """The ids of index rows ``picks`` (shard, offset, key, place), by their offsets: a shuffled read's order is ``place``."""
    width = "<u2" if vocabulary <= 65_536 else "<u4"
    wanted = picks.groupBy("shard").agg(F.collect_list(F.struct("place", "offset", "key")).alias("wanted"))
    return _shards(spark, path).join(wanted, "shard").select("content", "wanted").mapInArrow(_picked(width), "place long, key long, ids array<long>")


def record_digests(docs: DataFrame, tokenizer: str, *, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as records, index them, and return (doc_id, start, n_tokens, ids_crc32) as the files have them.

    The record files are deleted once they are indexed; the rows returned are those of the index.
    """
    spark = docs.sparkSession
    files = shared_dir(spark)
    write_records(docs, files, tokenizer, end_id=end_id)
    index = write_index(spark, files, shared_dir(spark))
    removed(spark, files)
    return index.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "shard", "offset")
