"""Records in bytes, joins with missing parts, chains, known digests."""

import hashlib
import struct

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.errors import CryptoFault, EncodingFault, InvalidInput, Unsupported
from tessella.functions import codecs, records, scalars
from tessella.functions.records import Reader, Tagged
from tessella.operators import chunks, objects, trees

PLAIN = st.one_of(
    st.integers(0, 2**64 - 1).map(lambda x: Tagged("u64", x)), st.integers(-(2**31), 2**31 - 1).map(lambda x: Tagged("i32", x)), st.text(max_size=9).map(lambda x: Tagged("string", x)),
    st.binary(max_size=9).map(lambda x: Tagged("bytes", x)), st.floats(allow_nan=False).map(lambda x: Tagged("f64", x)), st.booleans().map(lambda x: Tagged("bool", x)),
    st.tuples(st.booleans(), st.binary(max_size=6)).map(lambda x: Tagged("platform", x)),
)
ANY = st.recursive(PLAIN, lambda x: st.lists(x, max_size=3).map(lambda v: Tagged("list", v)) | st.dictionaries(st.text(max_size=4), x, max_size=3).map(lambda v: Tagged("map", v)))


@settings(max_examples=200, deadline=None)
@given(ANY, st.data())
def test_tagged_values_round_trip(value, data):
    raw = records.encode("any", value)
    assert Reader(raw).read("any") == value
    with pytest.raises((EncodingFault, Unsupported)):
        cut = raw[: data.draw(st.integers(0, len(raw) - 1))]
        Reader(cut).read("any")


def test_lengths_beyond_the_end_fail_before_anything_is_allocated():
    for kind in (["u64"], {"u64": "u64"}, "string", "bytes"):
        with pytest.raises(EncodingFault):
            Reader(b"\xff" * 8).read(kind)


def test_keyed_values_and_raw_bytes():
    raw = records.encode_keyed("size", "u32", 7)
    assert raw == b"\x04size\x07\0\0\0" and records.decode_keyed(Reader(raw), "size", "u32") == 7
    with pytest.raises(EncodingFault):
        records.decode_keyed(Reader(raw), "other", "u32")
    assert records.raw_bytes(Tagged("string", "é")) == "é".encode() and records.raw_bytes(Tagged("list", [])) is None and records.raw_bytes(Tagged("u16", 258)) == b"\x02\x01"
    assert records.platform_text((True, b"a\0")) == "a" and records.platform_text((False, b"\xff")) is None and records.platform_text((False, b"\xff"), lossy=True) == "\ufffd"


def test_segments_open_and_faults_have_kinds():
    head = records.SEGMENT_HEADER.encode(unique_identifier=0x5AFF, segment_number=3, chunkmap_size=32768)
    foot = records.SEGMENT_FOOTER.encode(length_of_segment=9, object_headers={1: 2}, object_footers={}, chunk_headers={712: 40}, same_bytes={}, duplicates={}, first_chunk_number=1, footer_offset=len(head))
    header, footer = records.open_segment(head + foot)
    assert header["segment_number"] == 3 and footer["chunk_headers"] == {712: 40} and records.next_header(header)["segment_number"] == 4
    last = head + foot + b"the container's own footer" + struct.pack("<Q", len(head + foot))
    assert records.open_segment(last) == (header, footer)
    with pytest.raises((EncodingFault, InvalidInput)):
        records.open_segment(bytes(7))
    with pytest.raises(EncodingFault):
        records.SEGMENT_HEADER.decode(head[:4] + struct.pack("<Q", 4) + head[12:])
    with pytest.raises(Unsupported):
        records.SEGMENT_HEADER.decode(head[:12] + b"\x63" + head[13:])


def test_payloads():
    assert records.payload("directory", [5, 6]) == struct.pack("<3Q", 2, 5, 6) and records.payload("hardlink", link_to=9) == struct.pack("<Q", 9)
    assert records.payload("symlink", target=(False, b"ab")) == b"\0" + struct.pack("<Q", 2) + b"ab" and records.payload("char", rdev=2049, code=1) == struct.pack("<QB", 2049, 1)


def test_known_digests(spark):
    data = [b"", b"abc", bytes(range(256))]
    got = spark.createDataFrame([(bytearray(x),) for x in data], "data binary").select("data", codecs.xxh3(F.col("data")).alias("x"), *(codecs.digest(n, F.col("data")).alias(n) for n in ("sha512", "sha3_256", "blake2b512"))).collect()
    for r in got:
        raw = bytes(r["data"])
        assert r["x"] == xxhash.xxh3_64_hexdigest(raw) and r["sha512"] == hashlib.sha512(raw).hexdigest() and r["sha3_256"] == hashlib.sha3_256(raw).hexdigest() and r["blake2b512"] == hashlib.blake2b(raw).hexdigest()
    assert {r["x"] for r in got if not r["data"]} == {"2d06800538d394c2"}
    assert {r["sha3_256"] for r in got if bytes(r["data"]) == b"abc"} == {"3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"}


def test_chains_of_any_length_and_circles(spark):
    rows = [(1, None), *((k, k - 1) for k in range(2, 40)), (50, None)]
    got = {r["chunk_no"]: r["target"] for r in chunks.resolved(spark.createDataFrame(rows, "chunk_no long, dup_of long")).collect()}
    assert got == {k: 1 for k in range(1, 40)} | {50: 50}
    with pytest.raises(InvalidInput):
        chunks.resolved(spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "chunk_no long, dup_of long")).collect()


def test_a_tree_of_a_hundred_levels(spark):
    files = spark.createDataFrame([(1, k, k - 1) for k in range(1, 101)], "object_no long, file_no long, parent_file_no long")
    assert sorted((r["file_no"], r["depth"]) for r in trees.depths(files).collect()) == [(k, k - 1) for k in range(1, 101)]


def test_missing_parts_and_wrong_keys_are_errors(spark):
    headers, footers = spark.createDataFrame([(1, "a"), (2, "b")], "file_no long, name string"), spark.createDataFrame([(1, 10)], "file_no long, n long")
    with pytest.raises(Exception, match="MissingPart: no footer for 2"):
        objects.joined(headers, footers, "file_no").collect()
    assert objects.joined(headers.filter("file_no = 1"), footers, "file_no").count() == 1 and objects.without(headers, footers, "file_no").first()["file_no"] == 2
    c = chunks.classified(spark.createDataFrame([(1, 1, 0, 1, 3, bytearray(b"abc"))], "object_no long, file_no long, ordinal int, chunk_no long, n_bytes int, data binary"), 8)
    sealed = chunks.encoded(c, None, key=bytes(32))
    assert bytes(chunks.decoded(sealed, None, key=bytes(32)).first()["data"]) == b"abc"
    with pytest.raises(Exception, match="CryptoFault"):
        chunks.decoded(sealed, None, key=bytes(range(32))).collect()
    with pytest.raises(CryptoFault):
        objects.require_key(True, None)


def test_numbers_and_order(spark):
    raw = [(bytearray(struct.pack("<qd", n, x)), n, x) for n, x in ((-1, 0.5), (-(2**63), -3.25e-310), (2**63 - 1, 1.7e308), (0, -0.0), (5, float("inf")))]
    got = spark.createDataFrame(raw, "b binary, n long, x double").select("n", "x", scalars.le_signed(F.substring("b", 1, 8)).alias("gn"), scalars.le_double(F.substring("b", 9, 8)).alias("gx")).collect()
    assert all(r["n"] == r["gn"] and r["x"] == r["gx"] for r in got)
    strings = spark.createDataFrame([(True, bytearray(b"a\0")), (False, bytearray(b"b")), (False, bytearray(b"ab"))], "wide boolean, b binary")
    assert [bytes(r["b"]) for r in strings.orderBy(scalars.platform_order(F.col("wide"), F.col("b"))).collect()] == [b"ab", b"b", b"a\0"]
    assert [r["file_no"] for r in objects.emission_order(spark.createDataFrame([(1, 1), (1, 3), (2, 1)], "object_no long, file_no long")).collect()] == [1, 3, 1]


def test_blocks_of_files_and_interrupted_reads(spark, tmp_path):
    from tessella.sources import filesystem

    raw = bytes(range(256)) * 41 + b"end"
    (tmp_path / "image").write_bytes(raw)
    (tmp_path / "nothing").write_bytes(b"")
    filesystem.register(spark)
    got = spark.read.format("evidence_blocks").option("path", f"{tmp_path}/image,{tmp_path}/nothing").option("size", 1000).option("task_bytes", 3000).load().orderBy("path", "ordinal").collect()
    assert b"".join(bytes(r["data"]) for r in got) == raw and [r["ordinal"] for r in got] == [*range(11), 0] and {r["status"] for r in got} == {"ok"}

    class Bad:
        def __init__(self, fails):
            self.fails = fails

        def seek(self, at):
            pass

        def read(self, n):
            self.fails -= 1
            if self.fails >= 0:
                raise InterruptedError
            return b"x" * min(n, 3)

    reader = filesystem._BlockReader([], 7, 7, 0)
    assert reader.block(Bad(11), 0) == (b"x" * 7, "ok") and reader.block(Bad(12), 0) == (bytes(7), "zero")


def test_an_entry_that_vanishes_is_kept(spark, tmp_path, monkeypatch):
    import os

    from pyspark.sql.datasource import InputPartition

    from tessella.sources import filesystem

    (tmp_path / "a").write_bytes(b"abc")
    monkeypatch.setattr(os, "listdir", lambda path: ["a", "gone"])
    rows = list(filesystem._TreeReader([]).read(InputPartition(str(tmp_path))))
    assert [(r[0].rsplit("/", 1)[1], r[11]) for r in rows[1:]] == [("a", "ok"), ("gone", "ua")] and all(len(r) == 17 for r in rows)
