"""Operator 1: token ids in files, by canonical length-limited Huffman codes.

Ids are counted over all documents, a package-merge gives code lengths of at most MAX_BITS, and the
canonical codes follow from the lengths alone. A file is a table of blocks in ascending doc_id order;
each block decodes by itself through one lookup table, and every CHUNK tokens a checkpoint holds the
bit offset, so that all chunks of a block decode side by side.

Two passes need all counts first, so the ids go to a table in the shared folder in between. The codebook
has one entry per vocabulary id and is the only thing that every task gets.

Null and empty texts hold the end id alone. Rows with a null doc_id come first; rows with equal doc_id follow
each other, the shorter first. Columns other than doc_id and text are ignored; an empty table gives an empty store."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text
from tessella.llm.tokens import vocabulary_size, word_ids

MAX_BITS = 18
CHUNK = 256
BLOCK_BYTES = 1 << 20
SLICE_TOKENS = 1 << 20
SLICE_BYTES = 1 << 24
PART_TOKENS = 1 << 23


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    out, used = np.zeros(len(counts), np.uint8), np.flatnonzero(counts)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, []
    for _ in range(limit - 1):
        whole = len(level) // 2 * 2
        both = np.concatenate([leaves, level[:whole].reshape(-1, 2).sum(1)])
        at = np.argsort(both, kind="stable")
        kinds.append(at < n)
        level = both[at]
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(kinds):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out[order] = lengths
    return out


@dataclass
class Codebook:
    """All of it follows from the code lengths."""

    lengths: np.ndarray

    def __post_init__(self) -> None:
        used = np.flatnonzero(self.lengths)
        used = used[np.argsort(self.lengths[used], kind="stable")]
        bits = self.lengths[used].astype(np.int64)
        room = 1 << (MAX_BITS - bits)
        self.codes = np.zeros(len(self.lengths), np.int64)
        self.codes[used] = (np.cumsum(room) - room) >> (MAX_BITS - bits)
        self.symbol, self.width = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.uint8)
        total = int(room.sum())
        self.symbol[:total], self.width[:total] = np.repeat(used, room), np.repeat(bits, room)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Payload and checkpoints of each text; ``sizes`` splits ``ids``. Payloads fill whole bytes."""
        bits = self.lengths[ids].astype(np.int64)
        ends = np.cumsum(bits)
        first = np.cumsum(sizes) - sizes
        before = np.where(first > 0, ends[np.maximum(first - 1, 0)], 0)
        after = ends[first + sizes - 1]
        whole = (after - before + 7) // 8
        start = np.cumsum(whole) - whole
        at = ends - bits + np.repeat(start * 8 - before, sizes)
        word, shift = at >> 5, 64 - (at & 31) - bits
        value = self.codes[ids] << shift
        edge = np.flatnonzero(np.diff(word, prepend=-1))
        buffer = np.zeros(int(whole.sum()) // 4 + 3, np.int64)
        buffer[word[edge]] += np.add.reduceat((value >> 32) & 0xFFFFFFFF, edge)
        buffer[word[edge] + 1] += np.add.reduceat(value & 0xFFFFFFFF, edge)
        raw = buffer.astype(">u4").tobytes()
        payloads = [raw[a : a + n] for a, n in zip(start.tolist(), whole.tolist(), strict=True)]
        marks = [(at[a + CHUNK : a + n : CHUNK] - 8 * s).astype("<u4").tobytes() for a, n, s in zip(first.tolist(), sizes.tolist(), start.tolist(), strict=True)]
        return payloads, marks

    def decode(self, payload: bytes, byte_sizes: np.ndarray, n_tokens: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of a block's texts; all its chunks go forward together, a token each time."""
        chunks = (n_tokens + CHUNK - 1) // CHUNK
        text = np.repeat(np.arange(len(n_tokens)), chunks)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = 8 * (np.cumsum(byte_sizes) - byte_sizes)[text]
        at[nth > 0] += marks
        left = np.minimum(n_tokens[text] - nth * CHUNK, CHUNK)
        put = (np.cumsum(n_tokens) - n_tokens)[text] + nth * CHUNK
        order = np.argsort(-left, kind="stable")
        at, put, live = at[order], put[order], np.searchsorted(-left[order], -np.arange(CHUNK), "left")
        raw = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
        window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
        out = np.empty(int(n_tokens.sum()), "<u4")
        for step in range(CHUNK):
            n = live[step]
            if not n:
                break
            here = at[:n]
            peek = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
            out[put[:n] + step] = self.symbol[peek]
            at[:n] += self.width[peek]
        return out


FILE_SCHEMA = "part int, seq int, start_in_part long, n_ids long, doc_ids binary, known binary, n_tokens binary, byte_sizes binary, payload binary, checkpoints binary"


def _rows(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes come to ``most`` at most, one row at least."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


MAGIC, VERSION = "token-store", 1
BOOK_SCHEMA = "magic string, version int, tokenizer string, end_id long, lengths binary"


class TokenStore:
    """Writes documents' ids to block files and reads them back. A store is a folder: ``files`` holds the blocks, ``book`` one row with magic, version, the
    tokenizer's file name, the end id and the code length of each id, all that decoding needs. Without a ``path`` it lies in the shared folder until the driver ends."""

    def __init__(self, spark: SparkSession, tokenizer: str, end_id: int, path: str | None = None):
        self.spark, self.tokenizer, self.end_id = spark, tokenizer, end_id
        self.scratch = Scratch(spark, "token-store")
        self.path = path or self.scratch.path("store")
        self.size = max(vocabulary_size(tokenizer), end_id + 1)
        self.width = 2 if self.size <= 1 << 16 else 4

    def write(self, docs: DataFrame) -> TokenStore:
        path, width, size, kind = self.tokenizer, self.width, self.size, np.dtype(f"<u{self.width}")
        end = int(self.end_id).to_bytes(width, "little")

        def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = word_ids(path, width)
            for batch in batches:
                sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
                for a, b in _rows(sizes, SLICE_BYTES):
                    names, texts = (c.slice(a, b - a) for c in batch.columns)
                    yield pa.RecordBatch.from_arrays([names, words.column(texts, end)], names=["doc_id", "ids"])

        tokens = self.scratch.put("tokens", id_and_text(docs).mapInArrow(tokenise, "doc_id long, ids binary"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    total += np.bincount(np.frombuffer(x, kind), minlength=size) if len(x) > 4 * size else 0
                small = b"".join(x for x in batch.column(0).to_pylist() if len(x) <= 4 * size)
                total += np.bincount(np.frombuffer(small, kind), minlength=size)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"id": used.astype(np.int32), "n": total[used]})

        counted = tokens.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
        counts = np.zeros(size, np.int64)
        for row in counted:
            counts[row["id"]] = row["n"]
        lengths, parts = code_lengths(counts), max(1, -(-int(counts.sum()) // PART_TOKENS))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = Codebook(lengths)
            for batch in batches:
                raw = batch.column(1).to_pylist()
                sizes = np.asarray([len(x) // width for x in raw], np.int64)
                for a, b in _rows(sizes, SLICE_TOKENS):
                    payloads, marks = book.encode(np.frombuffer(b"".join(raw[a:b]), kind).astype(np.int64), sizes[a:b])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes[a:b]), pa.array(payloads, pa.binary()), pa.array(marks, pa.binary())], names=["doc_id", "n_tokens", "payload", "checkpoints"])

        coded = self.scratch.put("coded", tokens.mapInArrow(encode, "doc_id long, n_tokens long, payload binary, checkpoints binary"))
        self.scratch.drop("tokens")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, seq, start, held, held_bytes = TaskContext.get().partitionId(), 0, 0, [], 0

            def block() -> pa.RecordBatch:
                n = np.asarray([x[1] for x in held], np.int64)
                row = {
                    "part": part, "seq": seq, "start_in_part": start, "n_ids": int(n.sum()),
                    "doc_ids": np.asarray([x[0] or 0 for x in held], "<i8").tobytes(), "known": bytes(x[0] is not None for x in held),
                    "n_tokens": n.astype("<i8").tobytes(), "byte_sizes": np.asarray([len(x[2]) for x in held], "<i8").tobytes(),
                    "payload": b"".join(x[2] for x in held), "checkpoints": b"".join(x[3] for x in held),
                }
                types = {"part": pa.int32(), "seq": pa.int32()}
                return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary() if isinstance(v, bytes) else pa.int64())) for k, v in row.items()], names=list(row))

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append(row)
                    held_bytes += len(row[2])
                    if held_bytes >= BLOCK_BYTES:
                        yield block()
                        start, seq, held, held_bytes = start + sum(x[1] for x in held), seq + 1, [], 0
            if held:
                yield block()

        in_order = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "payload")
        in_order.mapInArrow(blocks, FILE_SCHEMA).write.option("compression", "zstd").parquet(f"{self.path}/files")
        book = [(MAGIC, VERSION, path.rsplit("/", 1)[-1], self.end_id, bytearray(lengths.tobytes()))]
        self.spark.createDataFrame(book, BOOK_SCHEMA).coalesce(1).write.parquet(f"{self.path}/book")
        self.scratch.drop("coded")
        return self

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenStore:
        """A store that any session has written; its tokenizer is known by name only, so it can be read but not written."""
        store = cls.__new__(cls)
        store.spark, store.path = spark, path
        return store

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (little-endian, 4 bytes each) and their CRC-32, all from the files."""
        book = self.spark.read.schema(BOOK_SCHEMA).parquet(f"{self.path}/book").first()
        if (book["magic"], book["version"]) != (MAGIC, VERSION):
            raise ValueError(f"no token store of version {VERSION}: {self.path}")
        lengths, files = np.frombuffer(bytes(book["lengths"]), np.uint8), self.spark.read.schema(FILE_SCHEMA).parquet(f"{self.path}/files")
        totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each range of doc_id
        before, start = {}, 0
        for part in sorted(totals):
            before[part], start = start, start + totals[part]

        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book = Codebook(lengths)
            for batch in batches:
                for row in batch.to_pylist():
                    n = np.frombuffer(row["n_tokens"], "<i8")
                    ids = book.decode(row["payload"], np.frombuffer(row["byte_sizes"], "<i8"), n, np.frombuffer(row["checkpoints"], "<u4").astype(np.int64))
                    first = np.cumsum(n) - n
                    raw = memoryview(ids).cast("B")
                    own = [bytes(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), n.tolist(), strict=True)]
                    names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["known"], np.uint8) == 0)
                    yield pa.RecordBatch.from_arrays([names, pa.array(first + before[row["part"]] + row["start_in_part"]), pa.array(n), pa.array(own, pa.binary()), pa.array([zlib.crc32(x) for x in own], pa.int64())], names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

        return files.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
