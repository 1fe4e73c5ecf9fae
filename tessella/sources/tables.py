"""Tables as evidence: every source gives files (object_no, file_no, file_type, filename, parent_file_no, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ["object_no", "file_no", "file_type", "filename", "parent_file_no", "content"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTRA = 1_000_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object 1: a file for each document, whole, and its source as a further column. Beside every 17th there is an empty file and beside every 13th
    a run of one byte, numbered from EXTRA on, so that these branches are never vacuous."""
    own = F.struct(F.col("doc_id").alias("no"), F.col("text").alias("t"))
    empty = F.when(F.col("doc_id") % 17 == 0, F.struct((F.lit(EXTRA) + F.col("doc_id")).alias("no"), F.lit("").alias("t")))
    run = F.when((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 17 != 0), F.struct((F.lit(EXTRA) + F.col("doc_id")).alias("no"), F.repeat(F.lit("A"), F.lit(700)).alias("t")))
    d = table(spark, sf_dir, "documents").select("source", F.explode(F.filter(F.array(own, empty, run), lambda x: x.isNotNull())).alias("x"))
    return d.select(F.lit(1).cast("long").alias("object_no"), F.col("x.no").alias("file_no"), F.lit("file").alias("file_type"), F.concat(F.lit("doc-"), F.col("x.no")).alias("filename"), F.lit(0).cast("long").alias("parent_file_no"), F.encode("x.t", "UTF-8").alias("content"), "source")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object 2."""
    return table(spark, sf_dir, "pages").select(F.lit(2).cast("long").alias("object_no"), F.col("page_id").alias("file_no"), F.lit("file").alias("file_type"), F.col("url").alias("filename"), F.lit(0).cast("long").alias("parent_file_no"), F.encode("html", "UTF-8").alias("content"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object 3: a directory for each conversation, a file for each turn. Numbers leave room for a thousand turns."""
    t = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + 1
    folders = t.select("conv_id").distinct().select(F.lit(3).cast("long").alias("object_no"), number.alias("file_no"), F.lit("directory").alias("file_type"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("filename"), F.lit(0).cast("long").alias("parent_file_no"), F.lit(b"").alias("content"))
    turns = t.select(F.lit(3).cast("long").alias("object_no"), (number + F.col("turn") + 1).alias("file_no"), F.lit("file").alias("file_type"), F.concat_ws("-", "turn", "role").alias("filename"), number.alias("parent_file_no"), F.encode("text", "UTF-8").alias("content"))
    return folders.unionByName(turns)
