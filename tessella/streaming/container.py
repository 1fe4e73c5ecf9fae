"""Containers on disk: a folder of Parquet partitioned by segment, written, appended to and read; also by a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import chunks, segments


def write(files: DataFrame, path: str, size: int, target: int, algorithm: str | None = "zstd", mode: str = "errorifexists") -> None:
    """Chunks are encoded, placed in segments and written; each segment's rows are ordered by chunk_no, so that row groups can be skipped."""
    done = chunks.encoded(chunks.classified(chunks.numbered(files, size), size), algorithm)
    _put(segments.assigned(done, target), path, mode)


def _put(placed: DataFrame, path: str, mode: str) -> None:
    columns = ["object_no", "file_no", "ordinal", "chunk_no", "n_bytes", "content_hash", "kind", "same_byte", "dup_of", "flags", "integrity_hash", "payload", "size", "segment_no"]
    placed.select(*columns).repartition("segment_no").sortWithinPartitions("segment_no", "chunk_no").write.mode(mode).partitionBy("segment_no").parquet(path)


def append(files: DataFrame, path: str, size: int, target: int, algorithm: str | None = "zstd") -> None:
    """Further files: chunk and segment numbers go on where the container ends, and contents that it has become duplicates of its chunks."""
    spark = files.sparkSession
    old = spark.read.parquet(path)
    last = old.agg(F.max("chunk_no").alias("c"), F.max("segment_no").alias("s")).first()
    new = chunks.numbered(files, size).withColumn("chunk_no", F.col("chunk_no") + last["c"])
    made = chunks.classified(new, size)
    held = old.filter("kind = 'raw'").groupBy("content_hash").agg(F.min("chunk_no").alias("held_no"))
    made = made.join(held, "content_hash", "left")
    again = F.col("held_no").isNotNull() & F.col("kind").isin("raw", "duplicate")
    made = made.withColumn("dup_of", F.when(again, F.col("held_no")).otherwise(F.col("dup_of"))).withColumn("kind", F.when(again, F.lit("duplicate")).otherwise(F.col("kind"))).drop("held_no")
    done = chunks.encoded(made, algorithm)
    placed = segments.assigned(done.withColumn("chunk_no", F.col("chunk_no") - last["c"]), target).withColumn("chunk_no", F.col("chunk_no") + last["c"])
    _put(placed.withColumn("segment_no", F.col("segment_no") + last["s"]), path, "append")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def payload_stream(stored: DataFrame) -> Iterator[bytes]:
    """Payloads in order, a partition at a time on the driver."""
    for row in stored.select("chunk_no", "payload").orderBy("chunk_no").toLocalIterator():
        yield bytes(row["payload"])


def append_stream(stream: DataFrame, path: str, size: int, target: int, checkpoint: str, algorithm: str | None = "zstd"):
    """Each micro-batch of files is appended; the first makes the container. A batch that is run again finds its own files and leaves them."""

    def take(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            old = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            if not batch.isEmpty():
                write(batch, path, size, target, algorithm)
            return
        fresh = batch.join(old.select("object_no", "file_no").distinct(), ["object_no", "file_no"], "left_anti")
        if not fresh.isEmpty():
            append(fresh, path, size, target, algorithm)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
