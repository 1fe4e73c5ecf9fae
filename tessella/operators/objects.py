"""Objects, files and their headers and footers as joins; a part that is missing is an error, never a lost row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import CryptoFault, MissingPart


def joined(headers: DataFrame, footers: DataFrame, *keys: str, what: str = "footer") -> DataFrame:
    """Headers with their footers. A header without one stops the query when its row is computed."""
    marked = footers.withColumn("_there", F.lit(True))
    key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    fault = F.raise_error(F.concat(F.lit(f"{MissingPart.__name__}: no {what} for "), key))
    return headers.join(marked, list(keys), "left").filter(F.coalesce(F.col("_there"), fault.cast("boolean"))).drop("_there")


def without(headers: DataFrame, footers: DataFrame, *keys: str) -> DataFrame:
    """The keys that ``joined`` would fail on."""
    return headers.join(footers, list(keys), "left_anti").select(*keys)


def passive(objects: DataFrame, others: DataFrame) -> DataFrame:
    """(object_no, passive_no, …) for each entry of passive_objects; one that isn't there is an error."""
    asked = objects.select("object_no", F.explode("passive_objects").alias("passive_no"))
    renamed = others.select(F.col("object_no").alias("passive_no"), *[c for c in others.columns if c != "object_no"])
    return joined(asked, renamed, "passive_no", what="passive object")


def overlaid(stored: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Every stored row, with the loaded values where there are any."""
    values = [c for c in stored.columns if c != key]
    side = loaded.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    return stored.join(side, key, "left").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def chunk_count(pages: DataFrame) -> DataFrame:
    """The container's chunks: the highest number of the page index, 0 if there is none."""
    return pages.agg(F.coalesce(F.max("hi"), F.lit(0)).cast("long").alias("n_chunks"))


def files_left(files: DataFrame, done: DataFrame) -> DataFrame:
    """(object_no, n_left), 0 included."""
    open_ = files.join(done.select("object_no", "file_no"), ["object_no", "file_no"], "left_anti").groupBy("object_no").agg(F.count("*").alias("n_left"))
    return files.select("object_no").distinct().join(open_, "object_no", "left").select("object_no", F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"))


def acquired(files: DataFrame, at: str) -> DataFrame:
    """(object_no, started, ended)."""
    return files.groupBy("object_no").agg(F.min(at).alias("started"), F.max(at).alias("ended"))


def emission_order(files: DataFrame) -> DataFrame:
    """Files as a source yields them: the one that was registered last comes first."""
    return files.orderBy(F.desc("object_no"), F.desc("file_no"))


def signed(hashes: Column) -> Column:
    """Some digest of array<struct<…, signature>> has a signature."""
    return F.exists(hashes, lambda h: h["signature"].isNotNull())


def opened(sealed: Column, plain: Column) -> Column:
    """``plain``, where decrypting gave it; a key that doesn't fit stops the query."""
    fault = F.raise_error(F.lit(f"{CryptoFault.__name__}: the key doesn't fit or the data were changed"))
    return F.when(sealed.isNull(), plain).otherwise(F.coalesce(plain, fault.cast("binary")))


def require_key(encrypted: bool, key: bytes | None) -> None:
    if encrypted and key is None:
        raise CryptoFault("an encrypted object needs a key")


def archive_entries(entries: DataFrame, archive_object: int, archive_file: int, object_no: int) -> tuple[DataFrame, DataFrame]:
    """(files, extents) of a virtual object over the entries of an archive that is stored already: one extent for each file that isn't empty, none for
    others; no byte is copied. ``entries``: ordinal, path, file_type, data_offset, length."""
    files = entries.select(F.lit(object_no).cast("long").alias("object_no"), (F.col("ordinal") + 1).cast("long").alias("file_no"), "file_type", F.col("path").alias("filename"), "length")
    held = entries.filter("file_type = 'file' and length > 0")
    extents = held.select(
        (F.col("ordinal") + 1).cast("long").alias("file_no"), F.lit(0).cast("long").alias("v_offset"), F.col("length").cast("long").alias("length"),
        F.lit(archive_object).cast("long").alias("src_object"), F.lit(archive_file).cast("long").alias("src_file"), F.col("data_offset").cast("long").alias("src_offset"),
    )
    return files, extents
