"""Chunks: cut, number, classify, deduplicate, encode and decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.errors import InvalidInput
from tessella.functions import codecs, scalars
from tessella.operators import objects
from tessella.sources.shared import stored

GROUP = 1 << 16
#: Fixed value: the last byte of a nonce for contents; header maps have 1.
CONTENT_PADDING = 0


def explode(files: DataFrame, size: int, *keep: str) -> DataFrame:
    """Fixed-size chunks, the last may be short; an empty file gives one empty chunk."""
    n = F.octet_length("content")
    last = F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))
    cut = files.filter(F.col("file_type") == "file").select("object_no", "file_no", *keep, "content", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    data = F.substring("content", F.col("ordinal") * size + 1, F.lit(size))
    return cut.select("object_no", "file_no", *keep, "ordinal", data.alias("data")).withColumn("n_bytes", F.octet_length("data"))


def file_footers(files: DataFrame, size: int) -> DataFrame:
    """Length, number of chunks (0 if empty, though an empty file takes a chunk number) and chunk numbers taken, without cutting."""
    n = F.octet_length("content").cast("long")
    return files.filter(F.col("file_type") == "file").select("object_no", "file_no", n.alias("n_bytes"), F.ceil(n / size).cast("long").alias("n_chunks"), F.greatest(F.ceil(n / size), F.lit(1)).cast("long").alias("taken"))


def first_chunks(footers: DataFrame) -> DataFrame:
    """Adds first_chunk: container-wide numbers from 1, over objects, then files. Files are summed by groups of GROUP numbers; only one row a
    group goes through a window without a key."""
    own = footers.withColumn("grp", F.floor(F.col("file_no") / GROUP))
    sums = own.groupBy("object_no", "grp").agg(F.sum("taken").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("object_no", "grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("object_no", "grp", before.alias("base"))
    inner = F.coalesce(F.sum("taken").over(Window.partitionBy("object_no", "grp").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("inner", inner).join(base, ["object_no", "grp"]).withColumn("first_chunk", (F.col("base") + F.col("inner") + 1).cast("long")).drop("grp", "inner", "base")


def numbered(files: DataFrame, size: int, *keep: str) -> DataFrame:
    """Chunks with chunk_no. Numbers come from the files' lengths: no chunk is sorted."""
    first = first_chunks(file_footers(files, size)).select("object_no", "file_no", "first_chunk")
    return explode(files, size, *keep).join(first, ["object_no", "file_no"]).withColumn("chunk_no", F.col("first_chunk") + F.col("ordinal")).drop("first_chunk")


def classified(chunks: DataFrame, size: int) -> DataFrame:
    """Adds content_hash, same_byte (full-size chunks only), dup_of (lowest earlier chunk of equal content) and kind. Only numbers and hashes are
    compared by content; what comes back to the chunks is joined by their own number, so contents that many chunks share gather nowhere."""
    hashed = chunks.withColumn("content_hash", F.sha2("data", 256))
    same = (F.col("n_bytes") == size) & scalars.same_byte(F.col("data"))
    hashed = hashed.withColumn("same_byte", F.when(same, F.conv(F.substring(F.hex("data"), 1, 2), 16, 10).cast("int")))
    narrow = hashed.filter("same_byte is null and n_bytes > 0").select("chunk_no", "content_hash")
    firsts = narrow.groupBy("content_hash").agg(F.min("chunk_no").alias("dup_of"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = narrow.join(firsts, "content_hash").filter("dup_of < chunk_no").select("chunk_no", "dup_of")
    kind = F.when(F.col("n_bytes") == 0, "empty").when(F.col("same_byte").isNotNull(), "same_bytes").when(F.col("dup_of").isNotNull(), "duplicate").otherwise("raw")
    return hashed.join(later, "chunk_no", "left").withColumn("kind", kind)


def resolved(chunks: DataFrame) -> DataFrame:
    """(chunk_no, target): dup_of followed to a chunk that is none, however long the chain: each round doubles the steps, until none is left. A
    dup_of that isn't there is the target itself; a circle is an error."""
    links = stored(chunks.filter("dup_of is not null").select("chunk_no", F.col("dup_of").alias("target")))
    n, rounds = links.count(), 0
    while True:
        further = links.select(F.col("chunk_no").alias("target"), F.col("target").alias("further"))
        if links.join(further, "target", "left_semi").isEmpty():
            break
        if 1 << rounds > n:
            raise InvalidInput("a chunk duplicates itself")
        links = stored(links.join(further, "target", "left").select("chunk_no", F.coalesce("further", "target").alias("target")))
        rounds += 1
    return chunks.select("chunk_no").join(links, "chunk_no", "left").select("chunk_no", F.coalesce("target", "chunk_no").alias("target"))


def encoded(chunks: DataFrame, algorithm: str | None = "zstd", level: int = 3, threshold: float = 1.05, key: bytes | None = None) -> DataFrame:
    """Adds payload, flags and integrity_hash in one projection. Same bytes come before duplicates, these before compressed and raw ones; the
    compressor gets null for all but raw chunks."""
    packed = codecs.compress(F.when(F.col("kind") == "raw", F.col("data")), algorithm, level, threshold) if algorithm else F.lit(None).cast("binary")
    out = chunks.withColumn("packed", packed).withColumn("integrity_hash", codecs.xxh3(F.col("data")))
    plain = F.when(F.col("kind") == "same_bytes", F.substring("data", 1, 1)).when(F.col("kind") == "duplicate", F.unhex(scalars.le_hex(F.col("dup_of")))).otherwise(F.coalesce("packed", "data"))
    flags = scalars.pack_flags(compression=F.col("packed").isNotNull(), same_bytes=F.col("kind") == "same_bytes", duplicate=F.col("kind") == "duplicate", empty_file=F.col("kind") == "empty", encryption=F.lit(key is not None))
    payload = codecs.seal(plain, key, scalars.nonce_hex(F.col("chunk_no"), CONTENT_PADDING)) if key else plain
    return out.withColumn("flags", flags).withColumn("payload", payload).withColumn("size", F.octet_length("payload").cast("long")).drop("packed")


def decoded(stored_chunks: DataFrame, algorithm: str | None = "zstd", key: bytes | None = None) -> DataFrame:
    """(object_no, file_no, ordinal, chunk_no, data): decrypt, then decompress, then expand or look up. Only duplicates and their sources meet in a
    join. A key that doesn't fit stops the query."""
    plain = objects.opened(F.col("payload"), codecs.unseal(F.col("payload"), key, scalars.nonce_hex(F.col("chunk_no"), CONTENT_PADDING))) if key else F.col("payload")
    opened = stored_chunks.select("object_no", "file_no", "ordinal", "chunk_no", "n_bytes", "flags", plain.alias("plain"))
    has = lambda name: scalars.has_flag(F.col("flags"), name)
    unpacked = codecs.decompress(F.when(has("compression"), F.col("plain")), F.col("n_bytes"), algorithm) if algorithm else F.lit(None).cast("binary")
    own = opened.withColumn("unpacked", unpacked)
    data = F.when(has("same_bytes"), scalars.expand_same(F.hex("plain"), F.col("n_bytes"))).otherwise(F.coalesce("unpacked", "plain"))
    target = F.when(has("duplicate"), scalars.le_number(F.col("plain")).cast("long"))
    names = ["object_no", "file_no", "ordinal", "chunk_no"]
    whole = own.filter(~has("duplicate")).select(*names, data.alias("data"))
    again = opened.filter(has("duplicate")).select(*names, target.alias("target")).join(whole.select(F.col("chunk_no").alias("target"), "data"), "target", "left")
    return whole.unionByName(again.select(*names, "data"))


def verified(stored: DataFrame, data: DataFrame) -> DataFrame:
    """(chunk_no, intact): the integrity hash again, against the stored one."""
    again = data.select("chunk_no", codecs.xxh3(F.col("data")).alias("again"))
    return stored.select("chunk_no", "integrity_hash").join(again, "chunk_no").select("chunk_no", (F.col("again") == F.col("integrity_hash")).alias("intact"))


def reassembled(chunks: DataFrame) -> DataFrame:
    """Ordered concatenation for each file; a file must fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "data")))
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: F.hex(x["data"])), ""))
    return chunks.groupBy("object_no", "file_no").agg(joined.alias("content"))


def read_range(chunks: DataFrame, requests: DataFrame, size: int) -> DataFrame:
    """(request_no, content) for (request_no, object_no, file_no, offset, length). Each request asks for its chunks by number, so no other chunk meets
    it; what lies beyond the end is not there."""
    lo, hi = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1) / size)
    asked = requests.select("request_no", "object_no", "file_no", "offset", "length", lo.alias("first"), F.explode(F.sequence(lo, hi)).alias("ordinal"))
    own = asked.join(chunks.select("object_no", "file_no", F.col("ordinal").cast("long").alias("ordinal"), "data"), ["object_no", "file_no", "ordinal"])
    got = own.groupBy("request_no", "offset", "length").agg(F.min("ordinal").alias("first"), F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "data"))), lambda x: F.hex(x["data"])), "")).alias("joined"))
    part = F.substring("joined", (F.col("offset") - F.col("first") * size).cast("int") + 1, F.col("length").cast("int"))
    out = got.select("request_no", part.alias("content"))
    return requests.select("request_no").join(out, "request_no", "left").withColumn("content", F.coalesce("content", F.lit(b"")))


def point_read(chunks: DataFrame, chunk_no: Column | int) -> DataFrame:
    return chunks.filter(F.col("chunk_no") == chunk_no)


def digests(chunks: DataFrame, *names: str) -> DataFrame:
    """Order-sensitive digests of whole files from their chunks, all in one pass over each file's ordered chunks."""
    import hashlib

    import pandas as pd

    makers = {"sha256": hashlib.sha256, "sha512": hashlib.sha512, "sha3_256": hashlib.sha3_256, "blake2b512": hashlib.blake2b}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        machines = [makers[n]() for n in names]
        for data in pdf.sort_values("ordinal")["data"]:
            for m in machines:
                m.update(data)
        return pd.DataFrame({"object_no": pdf["object_no"].iloc[0], "file_no": pdf["file_no"].iloc[0], "hash_type": names, "digest": [m.hexdigest() for m in machines]})

    return chunks.select("object_no", "file_no", "ordinal", "data").groupBy("object_no", "file_no").applyInPandas(run, "object_no long, file_no long, hash_type string, digest string")
