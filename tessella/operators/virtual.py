"""Virtual files: extents over stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 20


def lookup(extents: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (read_no, file_no, offset, length) with the extents that they touch, by SPAN-wide buckets of the virtual offset: an equi-join, whatever the number of extents.
    Adds from and n: the part of the extent, and at: its place in the read."""
    bucket = lambda a, n: F.sequence(F.floor(a / SPAN), F.floor((a + F.greatest(n, F.lit(1)) - 1) / SPAN))
    e = extents.withColumn("bucket", F.explode(bucket(F.col("v_offset"), F.col("length"))))
    r = reads.select("read_no", "file_no", F.col("offset").alias("r_offset"), F.col("length").alias("r_length")).withColumn("bucket", F.explode(bucket(F.col("r_offset"), F.col("r_length"))))
    met = e.join(r, ["file_no", "bucket"]).filter((F.col("v_offset") < F.col("r_offset") + F.col("r_length")) & (F.col("v_offset") + F.col("length") > F.col("r_offset")))
    lo, hi = F.greatest("v_offset", "r_offset"), F.least(F.col("v_offset") + F.col("length"), F.col("r_offset") + F.col("r_length"))
    return met.drop("bucket").dropDuplicates(["read_no", "file_no", "v_offset"]).withColumn("from", F.col("src_offset") + lo - F.col("v_offset")).withColumn("n", hi - lo).withColumn("at", lo - F.col("r_offset"))


def read(extents: DataFrame, reads: DataFrame, files: DataFrame) -> DataFrame:
    """(read_no, content): the touched parts of the source files in order."""
    parts = lookup(extents, reads).join(files.select(F.col("object_no").alias("src_object"), F.col("file_no").alias("src_file"), "content"), ["src_object", "src_file"])
    cut = F.hex(F.substring("content", F.col("from").cast("int") + 1, F.col("n").cast("int")))
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", cut.alias("h")))), lambda x: x["h"]), ""))
    return parts.groupBy("read_no").agg(joined.alias("content"))


def chunks_of(parts: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """Adds the chunk numbers that each touched part needs; ``first`` has object_no, file_no, first_chunk."""
    own = parts.join(first.select(F.col("object_no").alias("src_object"), F.col("file_no").alias("src_file"), "first_chunk"), ["src_object", "src_file"])
    return own.withColumn("first_needed", F.col("first_chunk") + F.floor(F.col("from") / size)).withColumn("last_needed", F.col("first_chunk") + F.floor((F.col("from") + F.col("n") - 1) / size))
