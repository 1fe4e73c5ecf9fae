"""Operator 9: exact top-k search by Fagin's threshold algorithm.

Candidates form blocks, and each block sorts its vectors once along every dimension. A query goes down these
lists, from the top where its component is positive and from the bottom where it is negative, scores what it meets for the first
time, and stops when even a vector with the last seen value in every dimension could not reach its kth result. Every query
meets every block; the blocks' results are merged by rank.

Components become floor(1024 * x), and scores are exact integers; what is beyond 64 bits becomes the nearest long. Null vectors and those with null or non-finite components take no part, and only vectors
of one length are compared. Ties go to the smaller vec_id. A row is no candidate for itself, but a repeated row with
its vec_id is one. Rows with a null vec_id take no part. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch

BLOCK = 4096
QUERIES_PER_SLOT = 256
FIRST_DEPTH = 64
BROADCAST_BYTES = 16 << 20  # of query vectors; more are joined by shuffle
LONG = (1 << 63) - 1


def _pack(uid: np.ndarray, ids: np.ndarray, x: np.ndarray) -> bytes:
    return zstandard.compress(np.asarray([len(uid), x.shape[1]], "<i8").tobytes() + uid.astype("<i8").tobytes() + ids.astype("<i8").tobytes() + x.astype("<i8").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), "<i8")
    n, d = int(raw[0]), int(raw[1])
    return raw[2 : 2 + n], raw[2 + n : 2 + 2 * n], raw[2 + 2 * n :].reshape(n, d)


def _quantised(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(uid, vec_id, integers) for each length of vectors."""
    lists = batch.column("embedding")
    rows: dict[int, list[int]] = {}
    for i, x in enumerate(lists.to_pylist()):
        if x is not None and None not in x:
            rows.setdefault(len(x), []).append(i)
    uid, ids = batch.column("uid").to_numpy(), batch.column("vec_id").to_numpy()
    for d, own in rows.items():
        at = np.asarray(own)
        x = np.asarray(lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(own), d)
        fine = np.isfinite(x).all(1)
        whole = np.floor(1024 * x[fine])
        yield uid[at[fine]], ids[at[fine]], np.where(whole >= 2.0**63, LONG, np.where(whole < -(2.0**63), -LONG - 1, np.clip(whole, -(2.0**63), 2.0**63 - 1024).astype(np.int64)))


class Lists:
    """A block's vectors, sorted along each dimension."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows by vec_id: ties of a score then fall to the smaller
        self.uid, self.ids, self.x = uid[order], ids[order], x[order]
        self.most = max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))
        self.as_kind: dict = {}
        self.by = np.argsort(self.x, axis=0, kind="stable").T.copy()

    def _exact(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and the query in the fastest numbers that hold every product and every sum of them exactly."""
        bound = max(1, self.x.shape[1]) * max(1, self.most) * max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))
        kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object
        if kind not in self.as_kind:
            self.as_kind[kind] = self.x.astype(kind)
        return self.as_kind[kind], q.astype(kind)

    def top(self, uid: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best rows but the query's own."""
        n, used = len(self.ids), np.flatnonzero(q)
        seen = self.uid == uid
        y, q_scored = self._exact(q)
        longs = lambda s: s.astype(np.int64) if y.dtype != object else np.asarray([min(max(v, -LONG - 1), LONG) for v in s.tolist()], np.int64)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(used):
            rows = np.flatnonzero(~seen)[:k]
            return rows, np.zeros(len(rows), np.int64)
        down = q[used] > 0
        at, depth = 0, FIRST_DEPTH
        while at < n:
            to = min(n, at + depth)
            met = np.concatenate([self.by[used[down], n - to : n - at].ravel(), self.by[used[~down], at:to].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, longs(y[new] @ q_scored)])
            best = np.lexsort((rows, ~scores))[:k]
            rows, scores = rows[best], scores[best]
            edge = np.where(down, n - to, to - 1)
            bound = min(int((q_scored[used] * y[self.by[used, edge], used]).sum()), LONG)
            if len(rows) == k and scores[-1] > bound:
                break
            at, depth = to, depth * 2
        return rows, scores


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession, "topk")
    told = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    told = scratch.put("vectors", told.filter("vec_id is not null and embedding is not null").withColumn("uid", F.monotonically_increasing_id()))
    asked = told.filter(F.pmod("vec_id", F.lit(every)) == 0)
    n, n_bytes = asked.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("embedding") + 16), F.lit(0))).first()
    slots = max(1, -(-n // QUERIES_PER_SLOT))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, ids, x in _quantised(batch):
                for a in range(0, len(uid), BLOCK):
                    yield pa.RecordBatch.from_pydict({"block": [_pack(uid[a : a + BLOCK], ids[a : a + BLOCK], x[a : a + BLOCK])]})

    def slot(table: pa.Table) -> pa.Table:
        own = [_pack(*x) for b in table.combine_chunks().to_batches() for x in _quantised(b)]
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py()] * len(own), pa.int64()), "queries": pa.array(own, pa.binary())})

    queries = asked.withColumn("slot", F.pmod(F.xxhash64("uid"), F.lit(slots))).groupBy("slot").applyInArrow(slot, "slot long, queries binary")
    dealt = told.mapInArrow(blocks, "block binary").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    met = dealt.join(F.broadcast(queries) if n_bytes <= BROADCAST_BYTES else queries, "slot")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists = b"", None
        for batch in batches:
            for blob, asked_blob in zip(batch.column("block").to_pylist(), batch.column("queries").to_pylist(), strict=True):
                if blob != held:
                    held, lists = blob, Lists(*_unpack(blob))
                q_uid, q_id, q_x = _unpack(asked_blob)
                if q_x.shape[1] != lists.x.shape[1]:
                    continue
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for uid, name, q in zip(q_uid.tolist(), q_id.tolist(), q_x, strict=True):
                    rows, scores = lists.top(uid, q, k)
                    for column, values in zip(out, (np.full(len(rows), uid), np.full(len(rows), name), lists.ids[rows], lists.uid[rows], scores), strict=True):
                        column.append(values)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["uid", "query_id", "vec_id", "other", "score"])

    best = met.select("block", "queries").mapInArrow(search, "uid long, query_id long, vec_id long, other long, score long")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "other"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
