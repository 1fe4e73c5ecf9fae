"""Operator 2: best-fit packing with certified bin counts.

Documents are cut into pieces of at most CAPACITY tokens, and best-fit decreasing packs each partition.
Dual feasible functions over the partition's lengths give a lower bound on its bins. A partition whose count
equals its bound is done, certified. The others put their pieces together, are dealt anew over fewer, other partitions and
packed again, as long as that saves bins. Only lengths and digests move, never ids.

Null and empty texts give one piece, the end id. Repeated rows are packed each for itself; a null doc_id stays null.
Columns other than doc_id and text are ignored; an empty table gives no pieces."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text
from tessella.llm.tokens import word_ids
from tessella.llm.wordhash import buffers, runs

CAPACITY = 2048
PIECES_PER_PARTITION = 60_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be short."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of the dual feasible functions u(k) and of the family with a threshold (L2), rounded up; at least the volume bound."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((n * size).sum()) // capacity)
    for k in range(1, 21):  # u(k): x if (k+1)x is whole, else floor((k+1)x)/k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    count, volume = np.cumsum(n), np.cumsum(n * size)
    half = capacity // 2
    for t in range(half + 1):  # sizes over C-t alone; those over half keep theirs; those below t count nothing
        large = int(count[-1] - count[capacity - t])
        middle = int(count[capacity - t] - count[half])
        room = middle * capacity - int(volume[capacity - t] - volume[half])
        small = int(volume[half] - (volume[t - 1] if t else 0))
        best = max(best, large + middle + max(0, -(-(small - room) // capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length and the number of bins. Open bins lie in one list for each free space; a bit set finds the tightest."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces, bins = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fitting = spaces >> need
        if fitting:
            free = need + (fitting & -fitting).bit_length() - 1
            own = bins_with[free].pop()
            if not bins_with[free]:
                spaces &= ~(1 << free)
        else:
            own, free, bins = bins, capacity, bins + 1
        where[i], offset[i] = own, capacity - free
        if free > need:
            bins_with[free - need].append(own)
            spaces |= 1 << (free - need)
    return where, offset, bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        for batch in batches:
            words, out = word_ids(tokenizer, 4), {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for a, b in runs(buffers(batch.column(1))[1]):
                part = batch.slice(a, b - a)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    raw = memoryview(words.ids(text) + end)
                    for k, (first, n) in enumerate(cut(len(raw) // 4, capacity)):
                        for key, value in zip(out, (doc_id, k, first, n, zlib.crc32(raw[4 * first : 4 * (first + n)])), strict=True):
                            out[key].append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    made = id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("deal", F.monotonically_increasing_id())


def _packed(dealt: DataFrame, capacity: int, base: int) -> DataFrame:
    """Packs each ``part``; adds sequence_id, offset and the partition's bins and bound."""

    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        where, offset, bins = best_fit_decreasing(lengths, capacity)
        first = (base << 56) | (table.column("part")[0].as_py() << 26)
        n = table.num_rows
        for name, values in (("sequence_id", where + first), ("offset", offset), ("bins", np.full(n, bins)), ("bound", np.full(n, lower_bound(lengths, capacity)))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("part").applyInArrow(run, f"{PIECE}, part long, sequence_id long, offset long, bins long, bound long")


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the bins and the lower bound of the partition in which the piece was packed."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut_up = scratch.put("pieces", pieces(docs, tokenizer, end_id, capacity))
    parts = max(1, -(-cut_up.count() // PIECES_PER_PARTITION))
    deal = lambda df, n, salt: df.withColumn("part", F.pmod(F.xxhash64(F.col("deal"), F.lit(salt)), F.lit(n)))
    now, done = scratch.put("round0", _packed(deal(cut_up, parts, 0), capacity, 0)), []
    scratch.drop("pieces")
    for k in itertools.count(1):  # each round has half as many partitions
        sums = lambda df: df.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        open_ = sums(now).filter("bins > bound").agg(F.count("*").alias("n"), F.sum("bins").alias("bins")).first()
        if open_["n"] < 2:
            break
        gaps = now.filter("bins > bound")
        again = scratch.put(f"round{k}", _packed(deal(gaps.select(*[c.split()[0] for c in PIECE.split(", ")]), max(1, open_["n"] // 2), k), capacity, k))
        if sums(again).agg(F.sum("bins")).first()[0] >= open_["bins"]:
            break
        done.append(now.filter("bins <= bound"))
        now = again
    for part in done:
        now = now.unionByName(part)
    return now.drop("deal", "part")
