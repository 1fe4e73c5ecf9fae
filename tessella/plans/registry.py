"""Registered queries and, for each that SQL can express, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import codecs, records, scalars
from tessella.operators import chunks, keyed, objects, segments, trees, virtual
from tessella.sources import tables

CS = 256
TARGET = 65536
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = bytes(range(32))

FILES = """f as (select cast(1 as bigint) as object_no, doc_id as file_no, source, hex(encode(text)) as h from documents
union all select 1, 1000000000 + doc_id, source, case when doc_id % 17 = 0 then '' else repeat('41', 700) end from documents where doc_id % 17 = 0 or doc_id % 13 = 0),
f2 as (select *, cast(length(h) // 2 as bigint) as n from f)"""
CHUNKS = FILES + f""",
c0 as (select *, unnest(range(0, greatest(1, cast(ceil(n / {CS}.0) as bigint)))) as ordinal from f2),
c1 as (select object_no, file_no, source, n, ordinal, substr(h, 2 * {CS} * ordinal + 1, 2 * {CS}) as d from c0),
c as (select *, row_number() over (order by object_no, file_no, ordinal) as chunk_no, cast(length(d) // 2 as bigint) as n_bytes, sha256(unhex(d)) as content_hash from c1)"""
KINDS = CHUNKS + f""",
k0 as (select *, n_bytes = {CS} and d = repeat(substr(d, 1, 2), {CS}) as same from c),
k1 as (select *, case when not same and n_bytes > 0 then min(chunk_no) over (partition by content_hash, same) end as first_no from k0),
k as (select *, case when first_no < chunk_no then first_no end as dup_of, case when n_bytes = 0 then 'empty' when same then 'same_bytes' when first_no < chunk_no then 'duplicate' else 'raw' end as kind from k1)"""
SEGMENTS = CHUNKS + f""",
r as (select *, cast(coalesce(sum(n_bytes) over (order by chunk_no rows between unbounded preceding and 1 preceding), 0) as bigint) as before from c),
s as (select *, before // {TARGET} + 1 as segment_no from r)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    return chunks.numbered(tables.documents(spark, d), CS, "source")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return chunks.classified(_numbered(spark, d), CS)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return _numbered(spark, d).select("object_no", "chunk_no", F.col("n_bytes").cast("long").alias("size"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return segments.assigned(_sized(spark, d), TARGET)


@query(f"with {KINDS} select source, count(*) as n_chunks, count(distinct content_hash) as n_unique, cast(sum(n_bytes) as bigint) as raw_bytes, cast(sum(case when kind = 'raw' then n_bytes else 0 end) as bigint) as stored_bytes from k group by source")
def source_report(spark, d):
    """What deduplication saves in each source."""
    c = _classified(spark, d)
    return c.groupBy("source").agg(F.count("*").alias("n_chunks"), F.countDistinct("content_hash").alias("n_unique"), F.sum("n_bytes").alias("raw_bytes"), F.sum(F.when(F.col("kind") == "raw", F.col("n_bytes")).otherwise(0)).cast("long").alias("stored_bytes"))


@query(f"with {CHUNKS} select file_no, ordinal, n_bytes, lower(d) as data from c")
def chunk_explode(spark, d):
    c = chunks.explode(tables.documents(spark, d), CS)
    return c.select("file_no", F.col("ordinal").cast("long").alias("ordinal"), F.col("n_bytes").cast("long").alias("n_bytes"), F.lower(F.hex("data")).alias("data"))


@query(f"with {CHUNKS} select file_no, max(n) as n_bytes, cast(ceil(max(n) / {CS}.0) as bigint) as n_chunks, min(chunk_no) as first_chunk from c group by file_no")
def file_footer(spark, d):
    return chunks.first_chunks(chunks.file_footers(tables.documents(spark, d), CS)).select("file_no", "n_bytes", "n_chunks", "first_chunk")


@query(f"with {FILES} select object_no, cast(sum(n) as bigint) as n_bytes, cast(sum(greatest(1, ceil(n / {CS}.0))) as bigint) as n_chunks, count(*) as n_files, cast(1 as bigint) as first_chunk from f2 group by object_no union all select 2, cast(sum(octet_length(encode(html))) as bigint), cast(sum(greatest(1, ceil(octet_length(encode(html)) / {CS}.0))) as bigint), count(*), (select 1 + cast(sum(greatest(1, ceil(n / {CS}.0))) as bigint) from f2) from pages")
def object_footer(spark, d):
    both = tables.documents(spark, d).drop("source").unionByName(tables.pages(spark, d))
    own = chunks.first_chunks(chunks.file_footers(both, CS))
    return own.groupBy("object_no").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("taken").alias("n_chunks"), F.count("*").alias("n_files"), F.min("first_chunk").alias("first_chunk"))


@query(f"with {CHUNKS} select chunk_no, content_hash from c")
def chunk_hash(spark, d):
    return _numbered(spark, d).select("chunk_no", F.sha2("data", 256).alias("content_hash"))


@query(f"with {CHUNKS} select chunk_no, file_no, ordinal from c")
def chunk_numbering(spark, d):
    return _numbered(spark, d).select("chunk_no", "file_no", F.col("ordinal").cast("long").alias("ordinal"))


@query(f"with {FILES} select file_no, sha256(unhex(h)) as sha256 from f2")
def file_digest(spark, d):
    return tables.documents(spark, d).select("file_no", F.sha2("content", 256).alias("sha256"))


@query(f"with {FILES} select file_no, 'sha256' as hash_type, sha256(unhex(h)) as digest from f2")
def file_digest_from_chunks(spark, d):
    """The order-sensitive digest, from chunks."""
    return chunks.digests(chunks.explode(tables.documents(spark, d), CS), "sha256").drop("object_no")


@query(f"with {KINDS} select chunk_no, kind, cast(case when same then 65 end as integer) as same_byte, dup_of from k")
def chunk_kinds(spark, d):
    return _classified(spark, d).select("chunk_no", "kind", "same_byte", "dup_of")


@query(f"with {KINDS} select chunk_no, lower(substr(d, 1, 2)) as byte from k where same")
def same_byte_chunks(spark, d):
    return _numbered(spark, d).filter((F.col("n_bytes") == CS) & scalars.same_byte(F.col("data"))).select("chunk_no", F.lower(F.substring(F.hex("data"), 1, 2)).alias("byte"))


@query(f"with {KINDS} select chunk_no, dup_of from k where dup_of is not null")
def dedup_map(spark, d):
    return _classified(spark, d).filter("dup_of is not null").select("chunk_no", "dup_of")


@query(f"with {KINDS} select count(*) as n_chunks, cast(sum((kind = 'raw')::int) as bigint) as n_raw, cast(sum(case when kind = 'raw' then n_bytes else 0 end) as double) / sum(n_bytes) as ratio from k")
def dedup_ratio(spark, d):
    c = _classified(spark, d)
    raw = F.col("kind") == "raw"
    return c.agg(F.count("*").alias("n_chunks"), F.sum(raw.cast("long")).alias("n_raw"), (F.sum(F.when(raw, F.col("n_bytes")).otherwise(0)).cast("double") / F.sum("n_bytes")).alias("ratio"))


@query(f"with {KINDS} select chunk_no, coalesce(dup_of, chunk_no) as target from k")
def dup_resolve(spark, d):
    return chunks.resolved(_classified(spark, d))


@query(f"with {CHUNKS}, g as (select content_hash, list_sort(list(chunk_no)) as l from c where n_bytes > 0 group by content_hash having count(*) > 1) select content_hash, len(l) as n, array_to_string(l, ',') as chunk_nos from g")
def dedup_candidates(spark, d):
    """Hash -> set of chunk numbers."""
    c = _numbered(spark, d).filter("n_bytes > 0").groupBy(F.sha2("data", 256).alias("content_hash")).agg(F.sort_array(F.collect_set("chunk_no")).alias("l"))
    return c.filter(F.size("l") > 1).select("content_hash", F.size("l").cast("long").alias("n"), F.array_join("l", ",").alias("chunk_nos"))


@query(f"with {FILES} select file_no, lower(h) as content from f2")
def reassemble(spark, d):
    return chunks.reassembled(chunks.explode(tables.documents(spark, d), CS)).select("file_no", F.lower(F.hex("content")).alias("content"))


@query(f"with {FILES}, q as (select file_no as request_no, file_no, file_no % 700 as off, file_no % 900 as len from f2) select request_no, lower(case when off >= n then '' else substr(h, 2 * off + 1, 2 * len) end) as content from q join f2 using (file_no)")
def read_at(spark, d):
    """A byte range of each file across chunk borders; shorter at the end, empty beyond it."""
    files = tables.documents(spark, d)
    ask = files.select(F.col("file_no").alias("request_no"), "object_no", "file_no", (F.col("file_no") % 700).alias("offset"), (F.col("file_no") % 900).alias("length"))
    return chunks.read_range(chunks.explode(files, CS), ask, CS).select("request_no", F.lower(F.hex("content")).alias("content"))


@query(f"with {FILES} select file_no, greatest(0, n - 300) as size, sha256(unhex(substr(h, 601))) as sha256 from f2")
def read_to_end(spark, d):
    files = tables.documents(spark, d)
    start, n = scalars.checked_range(F.lit(300), F.octet_length("content"), F.octet_length("content"))
    return files.select("file_no", n.cast("long").alias("size"), F.sha2(F.substring("content", start + 1, n), 256).alias("sha256"))


@query(f"with {FILES} select file_no, file_no % 5 - 2 as by, case when file_no % 5 - 2 >= 0 then file_no % 5 - 2 end as from_start, case when 1 + file_no % 5 - 2 >= 0 then 1 + file_no % 5 - 2 end as from_current, case when n + file_no % 5 - 2 >= 0 then n + file_no % 5 - 2 end as from_end from f2")
def seek(spark, d):
    n, by = F.octet_length("content").cast("long"), F.col("file_no") % 5 - 2
    at = lambda base: scalars.seek(F.lit(base), n, F.lit(1).cast("long"), by)
    return tables.documents(spark, d).select("file_no", by.alias("by"), at("start").alias("from_start"), at("current").alias("from_current"), at("end").alias("from_end"))


@query(f"with {FILES} select file_no, sha256(unhex(substr(h, 21, 80))) as digest from f2")
def range_digest(spark, d):
    return tables.documents(spark, d).select("file_no", F.sha2(F.substring("content", 11, 40), 256).alias("digest"))


@query(f"with {SEGMENTS} select chunk_no, segment_no from s")
def segment_assign(spark, d):
    return _placed(spark, d).select("chunk_no", "segment_no")


@query()
def segment_assign_greedy(spark, d):
    """As a writer rolls over: the chunk that reaches the target ends its segment."""
    return segments.assigned_greedily(_sized(spark, d), TARGET)


@query(f"with {SEGMENTS} select chunk_no, segment_no, cast(coalesce(sum(n_bytes) over (partition by segment_no order by chunk_no rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from s")
def chunk_offsets(spark, d):
    return segments.offsets(_placed(spark, d)).select("chunk_no", "segment_no", "offset")


_PAGES = SEGMENTS + ", p as (select *, (row_number() over (partition by object_no, segment_no order by chunk_no) - 1) // 50 as page_no from s), i as (select segment_no, page_no, max(chunk_no) as hi, count(*) as n_entries from p group by all)"


def _index(spark, d):
    return segments.page_index(segments.paged(_placed(spark, d), 50)).select("segment_no", "page_no", "hi", "n_entries")


@query(f"with {_PAGES} select segment_no, page_no, hi, n_entries from i")
def page_index(spark, d):
    return _index(spark, d)


@query(f"with {_PAGES} select segment_no, page_no, hi, coalesce(lag(hi) over (order by hi) + 1, 1) as lo from i")
def page_first_chunk(spark, d):
    return segments.ceilings(_index(spark, d)).select("segment_no", "page_no", "hi", "lo")


@query(f"with {SEGMENTS} select segment_no, max(chunk_no) as hi, count(*) as n_chunks, cast(sum(n_bytes) as bigint) as n_bytes from s group by segment_no")
def segment_footers(spark, d):
    return _placed(spark, d).groupBy("segment_no").agg(F.max("chunk_no").alias("hi"), F.count("*").alias("n_chunks"), F.sum("size").alias("n_bytes"))


@query(f"with {SEGMENTS}, m as (select segment_no, max(chunk_no) as hi from s group by 1), w as (select 7 * file_no + 1 as chunk_no from f2) select w.chunk_no, m.segment_no from w asof left join m on w.chunk_no <= m.hi")
def chunk_to_segment(spark, d):
    """Ceiling lookup; numbers beyond the last have none."""
    wanted = tables.documents(spark, d).select((7 * F.col("file_no") + 1).alias("chunk_no"))
    ranges = segments.ceilings(_placed(spark, d).groupBy("segment_no").agg(F.max("chunk_no").alias("hi")))
    return segments.looked_up(wanted, ranges, few=False).select("chunk_no", "segment_no")


@query(f"with {_PAGES}, w as (select 7 * file_no + 1 as chunk_no from f2) select w.chunk_no, i.segment_no, i.page_no from w asof left join i on w.chunk_no <= i.hi")
def chunk_to_page(spark, d):
    wanted = tables.documents(spark, d).select((7 * F.col("file_no") + 1).alias("chunk_no"))
    return segments.looked_up(wanted, segments.ceilings(_index(spark, d)), few=False).select("chunk_no", "segment_no", "page_no")


@query(f"with {_PAGES}, l as (select *, coalesce(lag(hi) over (order by hi) + 1, 1) as lo from i) select p.chunk_no, 29 + 8 + 46 * (p.chunk_no - l.lo) as place from p join l using (segment_no, page_no)")
def page_slot(spark, d):
    """Place of a chunk's entry within its encoded page."""
    pages = segments.paged(_placed(spark, d), 50)
    return pages.join(segments.ceilings(_index(spark, d)), ["segment_no", "page_no"]).select("chunk_no", (F.lit(37) + 46 * (F.col("chunk_no") - F.col("lo"))).alias("place"))


@query("select doc_id as n, 'z' || case when doc_id < 10 then '0' else '' end || doc_id as extension, doc_id as back from documents")
def segment_name(spark, d):
    name = scalars.segment_extension(F.col("doc_id"))
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("n"), name.alias("extension"), scalars.segment_number(name).alias("back"))


@query("select * from (values (1, 'logical', 'documents'), (2, 'logical', 'pages'), (3, 'logical', 'conversations')) t(object_no, object_type, filename)")
def list_objects(spark, d):
    """Kinds in order, renumbered from 1."""
    made = lambda name: spark.createDataFrame([(name,)], "filename string").withColumn("object_type", F.lit("logical"))
    return keyed.renumbered(made("documents"), made("pages"), made("conversations"), order="filename").select(F.col("object_no").cast("int").alias("object_no"), "object_type", "filename")


@query("select doc_id as object_no, case when doc_id % 4 = 0 then 'encrypted' when doc_id % 4 = 1 then 'physical' when doc_id % 4 = 2 then 'logical' else 'virtual' end as object_type from documents where doc_id % 4 <> 0")
def list_open_objects(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("encrypted", "physical", "logical", "virtual")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return tables.table(spark, d, "documents").select(F.col("doc_id").alias("object_no"), kind.alias("object_type")).filter("object_type <> 'encrypted'")


@query(f"with {KINDS} select chunk_no, not (chunk_no % 10 = 0 and n_bytes > 0) as intact from k")
def integrity_verify(spark, d):
    """Encode, decode, damage every tenth chunk, and compare every chunk's integrity hash."""
    e = chunks.encoded(_classified(spark, d))
    flipped = F.unhex(F.concat(F.when(F.substring(F.hex("data"), 1, 1) == "0", "1").otherwise("0"), F.substring(F.hex("data"), 2, 1 << 30)))
    damaged = chunks.decoded(e).withColumn("data", F.when((F.col("chunk_no") % 10 == 0) & (F.octet_length("data") > 0), flipped).otherwise(F.col("data")))
    return chunks.verified(e, damaged)


@query()
def integrity_scan(spark, d):
    """XXH3-64 of every chunk."""
    return _numbered(spark, d).select("chunk_no", codecs.xxh3(F.col("data")).alias("integrity_hash"))


@query(f"with {KINDS} select file_no, sha256(unhex(max(h))) as digest from k join f2 using (file_no) group by file_no")
def encode_decode_roundtrip(spark, d):
    back = chunks.reassembled(chunks.decoded(chunks.encoded(_classified(spark, d))))
    return back.select("file_no", F.sha2("content", 256).alias("digest"))


@query(f"with {KINDS} select kind, count(*) as n, case kind when 'same_bytes' then 4 when 'duplicate' then 8 when 'empty' then 32 else 0 end as flags from k group by kind")
def encoded_flags(spark, d):
    e = chunks.encoded(_classified(spark, d), algorithm=None)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.max("flags").alias("flags"))


@query(f"with {CHUNKS} select chunk_no, lower(d) as data from c where chunk_no in (1, 5, 77)")
def point_read(spark, d):
    return _numbered(spark, d).filter(F.col("chunk_no").isin(1, 5, 77)).select("chunk_no", F.lower(F.hex("data")).alias("data"))


@query(f"with {CHUNKS} select file_no, chunk_no from c where n > 0")
def object_chunk_set(spark, d):
    """Chunk numbers of an object's files from their footers."""
    own = chunks.first_chunks(chunks.file_footers(tables.documents(spark, d), CS)).filter("n_chunks > 0")
    return own.select("file_no", F.explode(F.sequence("first_chunk", F.col("first_chunk") + F.col("n_chunks") - 1)).alias("chunk_no"))


@query("select conv_id * 1000 + 1 as parent_file_no, string_agg(conv_id * 1000 + 2 + turn, ',' order by turn) as children from conversations group by conv_id")
def dir_children(spark, d):
    return trees.children(tables.conversations(spark, d)).select("parent_file_no", F.array_join("children", ",").alias("children"))


@query("select distinct conv_id * 1000 + 1 as file_no from conversations")
def root_files(spark, d):
    return trees.roots(tables.conversations(spark, d)).select("file_no")


@query("select conv_id * 1000 + 2 + turn as file_no, 1 as depth from conversations union all select distinct conv_id * 1000 + 1, 0 from conversations")
def tree_depth(spark, d):
    return trees.depths(tables.conversations(spark, d)).select("file_no", "depth")


@query("with e as (select doc_id as file_no, doc_id % 40 as dev, doc_id % 90 as inode from documents), n as (select *, count(*) over (partition by dev, inode) as nlink, min(file_no) over (partition by dev, inode) as first_no from e) select file_no, case when nlink > 1 and first_no < file_no and file_no % 7 <> 0 then first_no end as link_to, case when nlink > 1 and first_no < file_no and file_no % 7 <> 0 then 'hardlink' when file_no % 7 = 0 then 'symlink' else 'file' end as file_type from n")
def hardlinks(spark, d):
    e = tables.table(spark, d, "documents").select(F.col("doc_id").alias("file_no"), (F.col("doc_id") % 40).alias("dev"), (F.col("doc_id") % 90).alias("inode"), F.when(F.col("doc_id") % 7 == 0, "symlink").otherwise("file").alias("file_type"))
    n = e.groupBy("dev", "inode").agg(F.count("*").alias("nlink"))
    linked = trees.hardlinks(e.join(n, ["dev", "inode"]))
    return linked.select("file_no", "link_to", scalars.as_hardlink(F.col("file_type"), F.col("link_to").isNotNull()).alias("file_type"))


_EXTENTS = """e as (select conv_id as file_no, doc_id as src_file, n, cast(coalesce(sum(n) over (partition by conv_id order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as v_offset from (select doc_id, doc_id // 10 as conv_id, octet_length(encode(text)) as n from documents))"""


def _extents(spark, d):
    """Virtual files: ten documents each, one after the other."""
    t = tables.table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("file_no"), F.col("doc_id").alias("src_file"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("length"))
    w = Window.partitionBy("file_no").orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("file_no", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("v_offset"), "length", F.lit(1).cast("long").alias("src_object"), "src_file", F.lit(0).cast("long").alias("src_offset"))


def _plain_files(spark, d):
    return tables.table(spark, d, "documents").select(F.lit(1).cast("long").alias("object_no"), F.col("doc_id").alias("file_no"), F.encode("text", "UTF-8").alias("content"))


def _reads(spark, d):
    return tables.table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 10).alias("file_no")).agg(F.lit(1000).cast("long").alias("offset"), F.lit(3000).cast("long").alias("length")).withColumn("read_no", F.col("file_no"))


@query(f"with {_EXTENTS} select file_no as read_no, src_file, greatest(0, 1000 - v_offset) as \"from\", least(v_offset + n, 4000) - greatest(v_offset, 1000) as n from e where v_offset < 4000 and v_offset + n > 1000")
def extent_lookup(spark, d):
    return virtual.lookup(_extents(spark, d), _reads(spark, d)).select("read_no", "src_file", "from", "n")


@query("with v as (select doc_id // 10 as read_no, string_agg(hex(encode(text)), '' order by doc_id) as h from documents group by 1) select read_no, lower(substr(h, 2001, 6000)) as content from v where length(h) > 2000")
def virtual_read(spark, d):
    return virtual.read(_extents(spark, d), _reads(spark, d), _plain_files(spark, d)).select("read_no", F.lower(F.hex("content")).alias("content"))


_FIRST = f"n0 as (select doc_id, greatest(1, cast(ceil(octet_length(encode(text)) / {CS}.0) as bigint)) as t from documents), fc as (select doc_id, cast(1 + coalesce(sum(t) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as first_chunk from n0)"


@query(f"with {_EXTENTS}, {_FIRST}, l as (select file_no as read_no, src_file, greatest(0, 1000 - v_offset) as a, least(v_offset + n, 4000) - greatest(v_offset, 1000) as n from e where v_offset < 4000 and v_offset + n > 1000) select read_no, src_file, first_chunk + a // {CS} as first_needed, first_chunk + (a + n - 1) // {CS} as last_needed from l join fc on fc.doc_id = l.src_file")
def extent_chunks(spark, d):
    """Which stored chunks a virtual read needs."""
    first = chunks.first_chunks(chunks.file_footers(_plain_files(spark, d).withColumn("file_type", F.lit("file")), CS))
    return virtual.chunks_of(virtual.lookup(_extents(spark, d), _reads(spark, d)), first, CS).select("read_no", "src_file", "first_needed", "last_needed")


@query("select doc_id, (doc_id % 2) * 1 + (doc_id // 2 % 2) * 2 + (doc_id // 4 % 2) * 4 + (doc_id // 8 % 2) * 8 + (doc_id // 16 % 2) * 16 + (doc_id // 32 % 2) * 32 + (doc_id // 64 % 2) * 64 as flags from documents")
def flag_pack(spark, d):
    on = {name: F.floor(F.col("doc_id") / bit) % 2 == 1 for name, bit in scalars.FLAGS.items()}
    return tables.table(spark, d, "documents").select("doc_id", scalars.pack_flags(**on).cast("long").alias("flags"))


@query("select doc_id from documents where doc_id % 128 & 8 <> 0 and doc_id % 128 & 2 = 0")
def flag_filter(spark, d):
    flags = (F.col("doc_id") % 128).cast("int")
    return tables.table(spark, d, "documents").filter(scalars.has_flag(flags, "duplicate") & ~scalars.has_flag(flags, "compression")).select("doc_id")


@query("""with e as (select event_id, case event_id % 8 when 0 then '.5' when 1 then '' when 2 then event_id || '..2' when 3 then '-' || event_id when 4 then event_id || '.1234567899'
    when 5 then '' || event_id when 6 then '0000000000000000000000000' || event_id || '.' else '99999999999' || event_id end as t from events),
p as (select *, regexp_full_match(t, '[0-9]*([.][0-9]*)?') as fine, ltrim(split_part(t, '.', 1), '0') as whole, rpad(substr(split_part(t, '.', 2), 1, 9), 9, '0') as part from e),
n as (select event_id, t, case when fine and length(whole) <= 20 then cast(case whole when '' then '0' else whole end || part as hugeint) end as v from p)
select event_id, t, case when v <= 18446744073709551615 then v::varchar end as ns from n""")
def pax_time(spark, d):
    e, kind = F.col("event_id").cast("string"), F.col("event_id") % 8
    forms = [F.lit(".5"), F.lit(""), F.concat(e, F.lit("..2")), F.concat(F.lit("-"), e), F.concat(e, F.lit(".1234567899")), e, F.concat(F.lit("0" * 25), e, F.lit(".")), F.concat(F.lit("99999999999"), e)]
    return tables.table(spark, d, "events").select("event_id", F.element_at(F.array(*forms), (kind + 1).cast("int")).alias("t")).withColumn("ns", scalars.pax_nanoseconds(F.col("t")).cast("string"))


@query("select event_id, ((user_id & 4095) << 8) | (event_id & 255) | ((event_id & 4294967040) << 12) as dev from events")
def makedev(spark, d):
    return tables.table(spark, d, "events").select("event_id", scalars.makedev(F.col("user_id"), F.col("event_id")).alias("dev"))


@query("with l as (select event_id, lpad(hex(event_id), 16, '0') as h from events) select event_id, lower(substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) || '00000003') as nonce from l")
def nonce(spark, d):
    return tables.table(spark, d, "events").select("event_id", scalars.nonce_hex(F.col("event_id"), 3).alias("nonce"))


@query("select event_id, event_id::varchar as number from events")
def le_roundtrip(spark, d):
    number = scalars.le_number(F.unhex(scalars.le_hex(F.col("event_id"))))
    return tables.table(spark, d, "events").select("event_id", number.cast("string").alias("number"))


@query("select doc_id, 'case=' || doc_id || ';ev=' || lang || ';no=' || source as entries from documents")
def description_map(spark, d):
    """A description from well-known and free keys, sorted by key."""
    m = F.create_map(F.lit("no"), F.col("source"), F.lit("case"), F.col("doc_id").cast("string"), F.lit("ev"), F.col("lang"))
    pairs = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return tables.table(spark, d, "documents").select("doc_id", F.array_join(pairs, ";").alias("entries"))


@query("select doc_id, 'a=' || lang || ';b=' || n_chars || ';c=' || source as entries from documents")
def metadata_merge(spark, d):
    """Two maps; the later one wins on b."""
    t = tables.table(spark, d, "documents").select("doc_id", F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.lit("old")).alias("x"), F.create_map(F.lit("b"), F.col("n_chars").cast("string"), F.lit("c"), F.col("source")).alias("y"))
    return t.select("doc_id", F.array_join(F.transform(keyed.merged_maps("x", "y"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("entries"))


@query("select doc_id as k, case when doc_id % 3 = 0 then 'new' else 'old' end as v from documents union all select doc_id + 1000000, 'new' from documents where doc_id % 3 = 0")
def keyed_upsert(spark, d):
    t = tables.table(spark, d, "documents")
    old = t.select(F.col("doc_id").alias("k"), F.lit("old").alias("v"))
    new = t.filter("doc_id % 3 = 0").select(F.explode(F.array("doc_id", F.col("doc_id") + 1000000)).alias("k"), F.lit("new").alias("v"))
    return keyed.upserted(old, new, "k")


@query("select doc_id as k, 'old' as v from documents union all select doc_id + 1000000, 'new' from documents where doc_id % 3 = 0")
def insert_if_absent(spark, d):
    t = tables.table(spark, d, "documents")
    old = t.select(F.col("doc_id").alias("k"), F.lit("old").alias("v"))
    new = t.filter("doc_id % 3 = 0").select(F.explode(F.array("doc_id", F.col("doc_id") + 1000000)).alias("k"), F.lit("new").alias("v"))
    return keyed.inserted_if_absent(old, new, "k")


@query("select doc_id, case doc_id % 6 when 0 then 0 when 1 then 1 when 2 then 2 when 3 then 3 end as code, case when doc_id % 2 = 0 then 'default' else 'access' end || ':user:' || case when doc_id % 3 = 0 then '' else doc_id::varchar end as acl, doc_id % 2 = 1 as root from documents")
def file_attributes(spark, d):
    """Special-file codes, ACL keys and the root-path test."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fifo", "char", "block", "socket", "file", "directory")]), (i % 6 + 1).cast("int"))
    path = F.when(i % 2 == 0, F.lit("./f")).otherwise(F.lit("/f"))
    return tables.table(spark, d, "documents").select("doc_id", scalars.special_code(kind).alias("code"), scalars.acl_key(i % 2 == 0, F.lit("user"), F.when(i % 3 != 0, i.cast("string"))).alias("acl"), scalars.is_root_path(path).alias("root"))


@query("select doc_id, case doc_id % 3 when 0 then 'zstd' when 1 then 'lz4' end as algorithm, case when doc_id % 2 = 0 then 512 else 256 end as bits from documents")
def algorithm_names(spark, d):
    i = F.col("doc_id")
    name = F.when(i % 3 == 0, "ZSTD").when(i % 3 == 1, "Lz4").otherwise("brotli")
    return tables.table(spark, d, "documents").select("doc_id", scalars.algorithm(name).alias("algorithm"), scalars.digest_bits(F.when(i % 2 == 0, "Blake2b512").otherwise("sha3_256")).alias("bits"))


@query("select doc_id, text as wide, text as narrow, true as bad_is_null from documents")
def platform_strings(spark, d):
    """Both encodings decode strictly; invalid bytes give null."""
    t = tables.table(spark, d, "documents")
    bad = F.try_validate_utf8(F.unhex(F.lit("FF41")).cast("string")).isNull()
    return t.select("doc_id", scalars.le_text(F.encode("text", "UTF-16LE"), F.lit(True)).alias("wide"), scalars.le_text(F.encode("text", "UTF-8"), F.lit(False)).alias("narrow"), bad.alias("bad_is_null"))


def _codec(name: str):
    def run(spark, d):
        c = _numbered(spark, d).filter("n_bytes > 0").withColumn("packed", codecs.compress(F.col("data"), name, threshold=1.01))
        back = codecs.decompress(F.col("packed"), F.col("n_bytes"), name)
        same = (F.col("n_bytes") == CS) & scalars.same_byte(F.col("data"))
        return c.select("chunk_no", (F.coalesce(back, F.col("data")) == F.col("data")).alias("intact"), F.when(same, F.col("packed").isNotNull() & (F.octet_length("packed") < CS)).alias("packed"))

    return run


for _name in ("zstd", "lz4"):
    QUERIES[f"{_name}_roundtrip"] = _codec(_name)
    ORACLE_SQL[f"{_name}_roundtrip"] = f"with {KINDS} select chunk_no, true as intact, case when same then true end as packed from k where n_bytes > 0"


@query(f"with {CHUNKS} select chunk_no, n_bytes + 16 as size, true as intact, true as wrong_key_is_null from c")
def aes_gcm_roundtrip(spark, d):
    n = scalars.nonce_hex(F.col("chunk_no"), 1)
    c = _numbered(spark, d).withColumn("sealed", codecs.seal(F.col("data"), KEY, n))
    return c.select("chunk_no", F.octet_length("sealed").cast("long").alias("size"), (codecs.unseal(F.col("sealed"), KEY, n) == F.col("data")).alias("intact"), codecs.unseal(F.col("sealed"), bytes(32), n).isNull().alias("wrong_key_is_null"))


@query(f"with {FILES} select file_no, sha256(unhex(h)) as sha256, 128 as sha512_len, 64 as sha3_len, 128 as blake2b_len from f2")
def other_digests(spark, d):
    f = tables.documents(spark, d)
    return f.select("file_no", codecs.digest("sha256", F.col("content")).alias("sha256"), F.length(codecs.digest("sha512", F.col("content"))).alias("sha512_len"), F.length(codecs.digest("sha3_256", F.col("content"))).alias("sha3_len"), F.length(codecs.digest("blake2b512", F.col("content"))).alias("blake2b_len"))


@query(f"with {SEGMENTS} select segment_no, '{{\"segment_no\":' || segment_no || ',\"hi\":' || max(chunk_no) || '}}' as record from s group by segment_no")
def footer_records(spark, d):
    """Footers as JSON."""
    return _placed(spark, d).groupBy("segment_no").agg(F.max("chunk_no").alias("hi")).select("segment_no", F.to_json(F.struct("segment_no", "hi")).alias("record"))


@query("select doc_id, doc_id % 3 = 0 as valid from documents")
def header_validation(spark, d):
    """Magic, version and length of a record, as a status."""
    i = F.col("doc_id")
    body = F.concat(F.when(i % 3 == 1, F.unhex(F.lit("00000000"))).otherwise(F.unhex(F.lit("54455331"))), F.unhex(scalars.le_hex(F.when(i % 3 == 2, F.lit(4)).otherwise(F.lit(15)).cast("long"))), F.unhex(F.lit("03AABB")))
    t = tables.table(spark, d, "documents").select("doc_id", body.alias("b"))
    valid = (F.hex(F.substring("b", 1, 4)) == "54455331") & (scalars.le_number(F.substring("b", 5, 8)) == F.octet_length("b")) & (F.hex(F.substring("b", 13, 1)) == "03")
    return t.select("doc_id", valid.alias("valid"))


_FULL = _PAGES.replace(f"// {TARGET}", f"// {1 << 20}").replace("// 50", "// 712")


@query(f"with {_FULL} select segment_no, page_no, hi, n_entries from i")
def page_index_full(spark, d):
    """Pages of 712 entries, as many as a page of the default size holds."""
    return segments.page_index(segments.paged(segments.assigned(_sized(spark, d), 1 << 20), 712)).select("segment_no", "page_no", "hi", "n_entries")


@query(f"with {_PAGES} select coalesce(max(hi), 0) as n_chunks from i")
def container_chunk_count(spark, d):
    return objects.chunk_count(_index(spark, d))


@query(f"with {KINDS}, t as (select *, case when n_bytes > 0 and not same then min(chunk_no) over (partition by content_hash, same) end as least from k) select chunk_no, coalesce(least, chunk_no) as target from t")
def dup_chain_resolve(spark, d):
    """Each duplicate names the one before it, so that a content with n chunks gives a chain of n - 1 steps."""
    c = _classified(spark, d).select("chunk_no", "content_hash", "kind")
    before = F.lag("chunk_no").over(Window.partitionBy("content_hash").orderBy("chunk_no"))
    return chunks.resolved(c.select("chunk_no", F.when(F.col("kind").isin("raw", "duplicate"), before).alias("dup_of")))


@query(f"with {KINDS} select kind, count(*) as n, 16 + case kind when 'same_bytes' then 4 when 'duplicate' then 8 when 'empty' then 32 else 0 end as flags, cast(sum(16 + case kind when 'same_bytes' then 1 when 'duplicate' then 8 else n_bytes end) as bigint) as stored from k group by kind")
def sealed_flags(spark, d):
    """Encrypted chunks: flags, and payloads with their tags."""
    e = chunks.encoded(_classified(spark, d), algorithm=None, key=KEY)
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.max("flags").alias("flags"), F.sum("size").alias("stored"))


@query(f"with {FILES} select file_no, sha256(unhex(h)) as digest from f2")
def sealed_roundtrip(spark, d):
    """Encode with compression and a key, decode, reassemble."""
    back = chunks.reassembled(chunks.decoded(chunks.encoded(_classified(spark, d), key=KEY), key=KEY))
    return back.select("file_no", F.sha2("content", 256).alias("digest"))


@query(f"with {FILES} select file_no, source, n as n_bytes, cast(ceil(n / {CS}.0) as bigint) as n_chunks from f2")
def file_parts(spark, d):
    """File headers with their footers; a file without a footer is an error."""
    files = tables.documents(spark, d)
    footers = chunks.file_footers(files, CS).drop("taken")
    return objects.joined(files.select("object_no", "file_no", "source"), footers, "object_no", "file_no").select("file_no", "source", "n_bytes", "n_chunks")


@query(f"with {FILES} select file_no from f2 where n = 0")
def files_without_chunks(spark, d):
    """The keys that the join of headers with footers would fail on, were empty files to have none."""
    files = tables.documents(spark, d)
    return objects.without(files, chunks.file_footers(files, CS).filter("n_chunks > 0"), "object_no", "file_no").select("file_no")


@query("select d.doc_id as object_no, p.doc_id as passive_no, p.lang from documents d join documents p on p.doc_id in (d.doc_id - 1, d.doc_id - 2) where d.doc_id % 3 = 0")
def passive_objects(spark, d):
    """Virtual objects with the objects that they read from."""
    t = tables.table(spark, d, "documents").select(F.col("doc_id").alias("object_no"), "lang")
    known = t.select(F.col("object_no").alias("no"))
    asked = t.filter("object_no % 3 = 0").select("object_no", F.explode(F.array(F.col("object_no") - 1, F.col("object_no") - 2)).alias("no"))
    virtual_objects = asked.join(known, "no", "left_semi").groupBy("object_no").agg(F.collect_list("no").alias("passive_objects"))
    return objects.passive(virtual_objects, t).select("object_no", "passive_no", "lang")


@query("select doc_id as k, case when doc_id % 4 = 0 then 'loaded' else lang end as v from documents")
def overlay(spark, d):
    t = tables.table(spark, d, "documents")
    return objects.overlaid(t.select(F.col("doc_id").alias("k"), F.col("lang").alias("v")), t.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("k"), F.lit("loaded").alias("v")), "k")


@query("select doc_id % 5 as object_no, cast(sum(case when doc_id % 3 = 0 or doc_id % 5 = 0 then 0 else 1 end) as bigint) as n_left from documents group by 1")
def files_left(spark, d):
    files = tables.table(spark, d, "documents").select((F.col("doc_id") % 5).alias("object_no"), F.col("doc_id").alias("file_no"))
    return objects.files_left(files, files.filter("file_no % 3 = 0 or object_no = 0"))


@query("select user_id % 50 as object_no, min(event_id) as started, max(event_id) as ended from events group by 1")
def acquisition_times(spark, d):
    return objects.acquired(tables.table(spark, d, "events").select((F.col("user_id") % 50).alias("object_no"), "event_id"), "event_id")


@query("select doc_id + 1 as file_no, cast(0 as bigint) as v_offset, octet_length(encode(text)) as length, cast(1 as bigint) as src_object, cast(7 as bigint) as src_file, 512 * doc_id as src_offset from documents where doc_id % 5 <> 0 and octet_length(encode(text)) > 0")
def virtual_archive(spark, d):
    """Extents of a virtual object over the entries of a stored archive."""
    kind = F.when(F.col("doc_id") % 5 == 0, "directory").otherwise("file")
    e = tables.table(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), F.concat(F.lit("p/"), F.col("doc_id")).alias("path"), kind.alias("file_type"), F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("length"), (512 * F.col("doc_id")).alias("data_offset"))
    return objects.archive_entries(e, 1, 7, 9)[1]


def _le_sql(x: str) -> str:
    return " || ".join(f"substr(lpad(hex({x}), 16, '0'), {k}, 2)" for k in range(15, 0, -2))


@query(f"with t as (select *, octet_length(encode(lang)) as n from documents) select doc_id, lower('0A' || {_le_sql('2')} || {_le_sql('4')} || '6C616E67' || '08' || {_le_sql('n')} || hex(encode(lang)) || {_le_sql('1')} || '6E' || '03' || {_le_sql('n_chars')}) as record, lang || '/' || n_chars as back, true as cut_is_null from t")
def metadata_records(spark, d):
    """Tagged metadata into bytes and back; what is cut off doesn't decode."""
    made = records.over(lambda lang, n: records.encode("any", records.Tagged("map", {"lang": records.Tagged("string", lang), "n": records.Tagged("u64", int(n))})), "binary")

    def read(raw: bytes) -> str:
        got = records.Reader(raw).read("any").value
        return f"{got['lang'].value}/{got['n'].value}"

    back = records.over(read, "string")
    t = tables.table(spark, d, "documents").select("doc_id", made("lang", "n_chars").alias("r"))
    return t.select("doc_id", F.lower(F.hex("r")).alias("record"), back("r").alias("back"), back(F.substring("r", F.lit(1), F.octet_length("r") - 1)).isNull().alias("cut_is_null"))


@query(f"select conv_id, lower({_le_sql('count(*)')} || string_agg({_le_sql('octet_length(encode(role))')} || hex(encode(role)), '' order by turn)) as record from conversations group by conv_id")
def string_lists(spark, d):
    """A list of texts in bytes, by built-in expressions."""
    t = tables.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    return t.select("conv_id", F.lower(F.hex(records.string_list(F.col("roles")))).alias("record"))


@query(f"with {SEGMENTS} select segment_no, segment_no || ':' || min(chunk_no) || ':' || max(chunk_no) || ':' || cast(sum(n_bytes) as bigint) as opened, true as zeros_are_null from s group by segment_no")
def segment_open(spark, d):
    """Segments in bytes, opened again: the header at the start, the footer by the last eight bytes."""

    def made(no: int, first: int, hi: int, size: int) -> bytes:
        head = records.SEGMENT_HEADER.encode(unique_identifier=0x5AFF, segment_number=no, chunkmap_size=32768)
        none = {n: {} for n in ("object_headers", "object_footers", "same_bytes", "duplicates")}
        return head + records.SEGMENT_FOOTER.encode(length_of_segment=size, chunk_headers={hi: len(head)}, first_chunk_number=first, footer_offset=len(head), **none)

    def opened(raw: bytes) -> str:
        header, footer = records.open_segment(raw)
        return f"{header['segment_number']}:{footer['first_chunk_number']}:{max(footer['chunk_headers'])}:{footer['length_of_segment']}"

    own = _placed(spark, d).groupBy("segment_no").agg(F.min("chunk_no").alias("first"), F.max("chunk_no").alias("hi"), F.sum("size").alias("n"))
    own = own.select("segment_no", records.over(made, "binary")("segment_no", "first", "hi", "n").alias("raw"))
    read = records.over(opened, "string")
    return own.select("segment_no", read("raw").alias("opened"), read(F.unhex(F.lit("00" * 7))).isNull().alias("zeros_are_null"))


@query("select event_id, -event_id as signed, value as number from events")
def le_numbers(spark, d):
    """Signed numbers and floats from little-endian bytes."""
    t = tables.table(spark, d, "events")
    raw = records.over(lambda n, x: records.encode("i64", int(n)) + records.encode("f64", x), "binary")
    t = t.select("event_id", raw(-F.col("event_id"), F.col("value")).alias("b"))
    return t.select("event_id", scalars.le_signed(F.substring("b", 1, 8)).alias("signed"), scalars.le_double(F.substring("b", 9, 8)).alias("number"))
