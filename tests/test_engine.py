"""Round trips, edge cases, sources and the growing container."""

import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tessella.errors import InvalidInput, Unsupported
from tessella.functions import codecs, scalars
from tessella.operators import chunks, segments, trees
from tessella.sources import filesystem
from tessella.streaming import container


def files(spark, *contents, first=1):
    return spark.createDataFrame([(1, i + first, "file", f"f{i}", 0, c) for i, c in enumerate(contents)], "object_no long, file_no long, file_type string, filename string, parent_file_no long, content binary")


def back(df):
    return {r["file_no"]: bytes(r["content"]) for r in chunks.reassembled(df).collect()}


@pytest.mark.parametrize("algorithm,key", [(None, None), ("zstd", None), ("lz4", None), ("zstd", bytes(32))])
def test_round_trip(spark, algorithm, key):
    contents = [b"", b"\xab" * 4096, b"0123456789abcdef" * 64, bytes(range(128)), os.urandom(300), b"\xab" * 100]
    c = chunks.classified(chunks.numbered(files(spark, *contents), 64), 64)
    e = chunks.encoded(c, algorithm, threshold=1.01, key=key)
    assert back(chunks.decoded(e, algorithm, key)) == dict(enumerate(contents, 1))
    assert {r["kind"] for r in c.collect()} == {"empty", "same_bytes", "duplicate", "raw"}
    assert chunks.verified(e, chunks.decoded(e, algorithm, key)).filter("not intact").isEmpty()


def test_a_short_tail_is_not_same_bytes(spark):
    c = chunks.classified(chunks.numbered(files(spark, b"A" * 130), 64), 64).orderBy("ordinal").collect()
    assert [r["kind"] for r in c] == ["same_bytes", "same_bytes", "raw"]


@pytest.mark.parametrize("offset,length", [(11, 30), (0, 16), (120, 30), (128, 5), (500, 5), (5, 0)])
def test_read_range(spark, offset, length):
    data = bytes(range(128))
    ask = spark.createDataFrame([(1, 1, 1, offset, length)], "request_no long, object_no long, file_no long, offset long, length long")
    got = chunks.read_range(chunks.explode(files(spark, data), 16), ask, 16).first()["content"]
    assert bytes(got) == data[offset : offset + length]


def test_compression_is_kept_only_if_worthwhile(spark):
    df = spark.createDataFrame([(b"\xab" * 4096,), (os.urandom(128),)], "d binary")
    got = [r[0] for r in df.select(codecs.compress(F.col("d"), "zstd")).collect()]
    assert got[0] is not None and got[1] is None
    with pytest.raises(InvalidInput):
        codecs.compress(F.col("d"), "zstd", threshold=0.0)
    with pytest.raises(Unsupported):
        codecs.digest("blake3", F.col("d"))


def test_greedy_segments_end_with_the_chunk_that_reaches_the_target(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([4, 4, 4, 10, 1, 1], 1)], "object_no long, chunk_no long, size long")
    assert [r["segment_no"] for r in segments.assigned_greedily(df, 8).orderBy("chunk_no").collect()] == [1, 1, 2, 2, 3, 3]


def test_unsigned_numbers(spark):
    df = spark.createDataFrame([(b"\xff" * 8,), (b"",)], "d binary")
    assert [r[0] for r in df.select(scalars.le_number(F.col("d")).cast("string")).collect()] == ["18446744073709551615", None]


def test_tree_and_tar_sources(spark, tmp_path):
    filesystem.register(spark)
    (tmp_path / "t/a").mkdir(parents=True)
    (tmp_path / "t/a/x").write_bytes(b"xyz")
    os.link(tmp_path / "t/a/x", tmp_path / "t/y")
    os.symlink("a/x", tmp_path / "t/s")
    tree = filesystem.numbered(spark.read.format("evidence_tree").load(str(tmp_path / "t")))
    got = {os.path.basename(r["path"]): r for r in trees.hardlinks(tree).collect()}
    assert got["s"]["file_type"] == "symlink" and bytes(got["y"]["content"]) == b"xyz"
    assert got["x"]["link_to"] == got["y"]["file_no"] and got["x"]["parent_file_no"] == got["a"]["file_no"]
    with tarfile.open(tmp_path / "t.tgz", "w:gz") as tar:
        tar.add(tmp_path / "t", "t")
    entries = spark.read.format("evidence_tar").load(str(tmp_path / "t.tgz"))
    kinds = {r["path"]: r["file_type"] for r in entries.collect()}
    assert kinds["t"] == "directory" and kinds["t/s"] == "symlink" and sorted(kinds.values()).count("hardlink") == 1
    assert trees.archive_links(entries).filter("missing").isEmpty()
    assert filesystem.binary_files(spark, str(tmp_path / "t/a")).count() == 1


def test_a_container_grows(spark, tmp_path):
    path = str(tmp_path / "c")
    container.write(files(spark, b"one" * 100, b"two" * 100), path, 64, 256)
    container.append(files(spark, b"one" * 100, b"new" * 50, first=3), path, 64, 256)
    stored = container.read(spark, path)
    numbers = sorted(r["chunk_no"] for r in stored.collect())
    assert numbers == list(range(1, len(numbers) + 1))
    assert back(chunks.decoded(stored)) == {1: b"one" * 100, 2: b"two" * 100, 3: b"one" * 100, 4: b"new" * 50}
    assert {r["kind"] for r in stored.filter("file_no = 3").collect()} == {"duplicate"}
    assert sum(len(x) for x in container.payload_stream(stored)) == stored.agg(F.sum("size")).first()[0]


def test_a_stream_appends_once(spark, tmp_path):
    incoming, path = str(tmp_path / "in"), str(tmp_path / "c")
    for k in range(2):
        files(spark, f"file {k}".encode() * 40, first=k + 1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(files(spark, b"").schema).parquet(incoming)
        container.append_stream(stream, path, 64, 256, str(tmp_path / "check")).awaitTermination()
    assert back(chunks.decoded(container.read(spark, path))) == {1: b"file 0" * 40, 2: b"file 1" * 40}


def test_depths_go_to_the_last_level(spark):
    files = spark.range(1, 68).selectExpr("1L as object_no", "id as file_no", "id - 1 as parent_file_no")
    assert {(r["file_no"], r["depth"]) for r in trees.depths(files).collect()} == {(k, k - 1) for k in range(1, 68)}
    twice = files.unionByName(spark.createDataFrame([(1, 2, 3)], files.schema))
    with pytest.raises(InvalidInput):
        trees.depths(twice)
