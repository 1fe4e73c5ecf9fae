"""Operator 8: a quality classifier by random Fourier features.

Statistics of each whole text are mapped by random cosines that approximate a Gaussian kernel. Partitions sum their
normal equations, the driver solves one ridge system of fixed size, and isotonic regression on labelled rows that the ridge has not
seen turns its output into a probability. Scores read the text alone.

Fitting takes the labelled rows outside the held-out fold, at most about TRAIN_ROWS of them, drawn by a hash of doc_id. Null
and empty texts have the statistics of an empty text and are scored like any other. Without usable labels all scores are the share of
label 1 (0.5 if there are none). Repeated rows each give a row; labels given twice count by their mean, null labels not
at all; a null doc_id is never a training row. Other columns are ignored."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text, per_row

COSINES = 256
GAMMA = 0.02
RIDGE = 1e-3
TRAIN_ROWS = 60_000
SUM_TASKS = 16
CUT = 0.7
SEED = 20240229


def statistics(text: bytes | None) -> list[float]:
    """What the kernel sees of a text; shares are smoothed so that tiny texts don't stand out."""
    text = text or b""
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    k, total = len(words), max(1, len(text))
    distinct = len(set(words))
    upper, lower, digits = int(n[65:91].sum()), int(n[97:123].sum()), int(n[48:58].sum())
    beyond = int(n[128:].sum())
    noise = int(sum(n[b] for b in b"#*$%&|<>"))
    again = sum(map(operator.eq, words, words[1:]))
    skip = sum(map(operator.eq, words, words[2:]))
    share = lambda x, y: x / (y + 2)
    return [
        np.log1p(k), np.log1p(len(lines)), share(total, k), share(distinct, k), share(again, k), share(skip, k), np.sqrt(share(noise, k)), np.sqrt(share(int(n[33]), k)),
        upper / (upper + lower + 5), share(digits, total), share(beyond, total), share(int(n[46] + n[44]), k), share(len(lines) - len(set(lines)), len(lines)),
        np.sqrt(share(int(n[124]), k)), share(int(n[63] + n[58] + n[59]), k), share(max(map(len, words), default=0), total), np.log1p(max(map(len, words), default=0)), share(int(n[61] + n[123] + n[125] + n[95]), k),
    ]


WIDTH = len(statistics(b""))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] | None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return np.full(len(x), self.weights[0])
        return np.clip(np.interp(self.raw(x), *self.steps), 0.0, 1.0)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    omega, phase = rng.normal(0, np.sqrt(2 * GAMMA), (x.shape[1], COSINES)), rng.uniform(0, 2 * np.pi, COSINES)
    z = np.sqrt(2 / COSINES) * np.cos(np.clip((x - mean) / scale, -8, 8) @ omega + phase)
    return np.hstack([np.ones((len(x), 1)), z])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the steps' middles and values, which are shrunk a little to the mean so that no score is certain."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][2] + last[0] * last[2]) / (pools[-1][2] + last[2]), pools[-1][1] + last[1], pools[-1][2] + last[2]]
    mean = float(y.mean())
    at = np.asarray([p[0] for p in pools])
    return at, np.asarray([(p[1] + mean) / (p[2] + 1) for p in pools])


def _matrix(batch: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<f8").reshape(-1, WIDTH)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(features: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = TRAIN_ROWS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("doc_id is not null and y is not null")
    known = known.filter(fold(F.col("doc_id")) != 2).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    of = known.agg(F.count("*").alias("n"), F.avg("y").alias("mean")).first()
    if not of["n"] or of["mean"] in (0.0, 1.0):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.asarray([0.5 if not of["n"] else of["mean"]]), None)
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, rows / of["n"]) * (1 << 20))
    train = scratch.put("train", features.join(known.filter(drawn), "doc_id").select("stats", "y", (fold(F.col("doc_id")) == 3).alias("calibrates")).repartition(SUM_TASKS))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, WIDTH))
        for b in batches:
            x = _matrix(b)
            total += np.stack([np.full(WIDTH, len(x)), x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    def summed(df: DataFrame, fn) -> np.ndarray:  # SUM_TASKS rows of fixed size
        return sum(np.frombuffer(r["sums"], "<f8") for r in df.mapInArrow(fn, "sums binary").collect())

    n, s, q = summed(train.filter("not calibrates"), moments).reshape(3, WIDTH)
    if not n[0]:
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.asarray([of["mean"]]), None)
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 1e-8))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for b in batches:
            z, y = cosines(_matrix(b), mean, scale), b.column("y").to_numpy()
            total += z.T @ np.hstack([z, y[:, None]])
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    system = summed(train.filter("not calibrates"), equations).reshape(COSINES + 1, COSINES + 2)
    weights = np.linalg.solve(system[:, :-1] + RIDGE * n[0] * np.diag([0.0] + [1.0] * COSINES) / COSINES + 1e-9 * np.eye(COSINES + 1), system[:, -1])
    model = Model(mean, scale, weights, None)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"x": model.raw(_matrix(b)), "y": b.column("y").to_numpy()})

    pairs = train.filter("calibrates").mapInArrow(outputs, "x double, y double").collect()  # a third of TRAIN_ROWS
    if not pairs:
        model.steps = np.asarray([0.0, 1.0]), np.asarray([0.0, 1.0])
    else:
        model.steps = isotonic(np.asarray([r["x"] for r in pairs]), np.asarray([r["y"] for r in pairs]))
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scratch = Scratch(docs.sparkSession, "classifier")

    def features(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "stats": [np.asarray(statistics(x), "<f8").tobytes() for x in texts]}

    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.binary())])
    told = scratch.put("features", id_and_text(docs).mapInArrow(per_row(features, schema), "doc_id long, stats binary"))
    model = fit(told, labels, scratch)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b)))], names=["doc_id", "score"])

    out = told.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
