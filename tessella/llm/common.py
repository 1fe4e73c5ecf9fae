"""Shared plumbing of the training-data operators: tables, shared scratch space, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, everywhere in this package: blank and \x09 to \x0D.
WORD_SPACE = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where none is set."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if not held:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        held = jvm_dir.get() if jvm_dir.isDefined() else None
    if not held:
        held = f"file://{tempfile.mkdtemp(prefix='tessella-')}"
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


class Scratch:
    """Tables written to the shared folder; they cut lineage and survive a lost executor.

    ``drop`` frees one early, ``drop_since`` all of those that were opened since then; the rest go when the driver ends."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.opened.append(self)
        self.names: set[str] = set()
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.names.add(name)
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.get(name, df)

    def put_by(self, key: str, buckets: int, name: str, df: DataFrame) -> DataFrame:
        """A table in buckets by ``key``, so that joins by it don't move its rows."""
        table = f"scratch_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").option("path", self.path(name)).saveAsTable(table)
        atexit.register(self._forget, table)
        return self.spark.table(table)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def keep(self, *names: str) -> None:
        """Drops all tables but these, once nothing else is read any more."""
        for name in self.names - set(names):
            self.drop(name)

    @classmethod
    def drop_since(cls, n: int) -> None:
        """What was opened after the first ``n``: for results that have been written elsewhere."""
        for own in cls.opened[n:]:
            own._delete(own.root)
        del cls.opened[n:]

    def drop(self, name: str) -> None:
        self.names.discard(name)
        self._delete(self.path(name))

    def _forget(self, table: str) -> None:
        try:
            self.spark.sql(f"drop table if exists {table}")
        except Exception:  # the session may have ended before
            pass

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before
            pass


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of any name cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def per_row(fn: Callable[[list, list], dict], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from ``fn(doc_ids, texts as bytes or None) -> columns``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return run
