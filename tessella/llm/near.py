"""Operator 7: near duplicates by bottom-k sketches from one hash function.

A document's set are its distinct word shingles; documents with equal sets form a class, so copies collapse before
anything else. A class keeps the SKETCH least hashes of its set. Inverted lists of retained values generate overlaps:
a pair at the threshold shares at least ``overlap(percent)`` retained values but for one chance in 10^12, so each class is listed under
its rarest values only, as many as leave no such pair without a common list. A list first links all its classes to two
centres. Only lists that still hold several components go on: short ones pair up their classes, long ones are dealt out in blocks whose
full sets are compared; nothing is capped. The sketch of the union estimates the similarity of each pair and filters with the same
certainty; exact Jaccard on the full sets confirms every link. Components come from minimum labels with
pointer jumping over tables in the shared folder.

A document without words or text is empty, linked with nothing, a component by itself. A row with a null doc_id can
link others; its component_id is the smallest known doc_id reachable, null if there is none, and it is kept
only then. Repeated rows share a class. Columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text
from tessella.llm.wordhash import buffers, hashes, rolled, runs

SHINGLE = 5
SKETCH = 48
MISSED = 1e-12
SHORT_LIST = 64
BLOCK_OF_LIST = 256
BROADCAST_ROWS = 500_000  # of 40 bytes each at most: 20 MB; more rows are joined by shuffle


def overlap(percent: int) -> int:
    """How many of the SKETCH least hashes of the union a pair at the threshold has in common, but for a chance of MISSED."""
    p, chance = percent / 100, 0.0
    for k in range(SKETCH + 1):
        chance += comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
        if chance > MISSED:
            return k
    return SKETCH


_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each whole text, A-Z in lower case, the sorted hashes of its distinct shingles."""
    for a, b in runs(buffers(texts)[1]):
        flat, sizes = hashes(*buffers(texts.slice(a, b - a)), lower=True)
        windows, first = rolled(flat, SHINGLE, _ROLL), 0
        for n in sizes.tolist():
            if n >= SHINGLE:
                yield np.unique(windows[first : first + n - SHINGLE + 1])
            else:
                yield rolled(flat[first : first + n], n, _ROLL) ^ np.uint64(n) if n else np.zeros(0, np.uint64)
            first += n


def _raw(texts: pa.Array) -> Iterator[bytes]:
    """The bytes of each text, a few MB at a time."""
    for a, b in runs(buffers(texts)[1]):
        yield from (x or b"" for x in texts.slice(a, b - a).cast(pa.binary()).to_pylist())


def _text_hashes(texts: pa.Array) -> pa.Array:
    return pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in _raw(texts)], pa.int64())


def _features(docs: DataFrame) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sketches = [], [], []
            for own in shingle_sets(batch.column(1)):
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                sketches.append(own[:SKETCH].view(np.int64).copy())
            md5 = [hashlib.md5(x, usedforsecurity=False).digest() for x in _raw(batch.column(1))]
            columns = [batch.column(0), pa.array(n, pa.int64()), _text_hashes(batch.column(1)), pa.array(md5, pa.binary()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "text_hash", "text_md5", "set_key", "sketch"])

    return docs.mapInArrow(fn, "doc_id long, n_shingles long, text_hash long, text_md5 binary, set_key binary, sketch array<long>")


def _texts(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """cls and text of the wanted (cls, doc_id, text_hash)."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _text_hashes(batch.column(1))], names=["of", "text", "hash"])

    own = docs.mapInArrow(fn, "of long, text string, hash long")
    side = F.broadcast(wanted) if few else wanted
    return own.join(side, own["of"].eqNullSafe(side["doc_id"]) & (own["hash"] == side["text_hash"])).select("cls", "text").dropDuplicates(["cls"])


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose union sketch leaves the threshold possible."""
    sa = classes.select(F.col("cls").alias("a"), F.col("sketch").alias("sa"))
    sb = classes.select(F.col("cls").alias("b"), F.col("sketch").alias("sb"))
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, SKETCH)
    both = pairs.join(sa, "a").join(sb, "b").withColumn("union", union)
    common = F.size(F.array_intersect(F.col("union"), F.array_intersect("sa", "sb")))
    return both.filter(common * SKETCH >= F.size("union") * overlap(percent)).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Exact Jaccard on full sets."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(shingle_sets(batch.column("ta")), shingle_sets(batch.column("tb")), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                links.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    ta, tb = texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), texts.select(F.col("cls").alias("b"), F.col("text").alias("tb"))
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(fn, "a long, b long")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cls, comp): the smallest cls reachable, for each cls with a link."""
    edges = scratch.put(f"{name}-edges", links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.put(f"{name}-0", edges.groupBy(F.col("a").alias("cls")).agg(F.min("b").alias("m")).select("cls", F.least("cls", "m").alias("comp")))
    step = 0
    while True:
        near = edges.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        nearer = labels.join(near, "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "near").alias("to"))
        roots = labels.select(F.col("cls").alias("to"), F.col("comp").alias("root"))
        step += 1
        new = scratch.put(f"{name}-{step}", nearer.join(roots, "to").select("cls", "was", F.least("to", "root").alias("comp")))
        scratch.drop(f"{name}-{step - 1}")
        labels = new.select("cls", "comp")
        if new.filter("was <> comp").isEmpty():
            return labels


COLUMNS = 4096
ENTRIES = 1 << 20


def _sets(texts: DataFrame) -> DataFrame:
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [x.view(np.int64) for x in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(own, pa.list_(pa.int64()))], names=["cls", "set"])

    return texts.select("cls", "text").mapInArrow(fn, "cls long, set array<long>")


def _block_links(groups: DataFrame, percent: int) -> DataFrame:
    """Links within each ``grp`` of ``held`` classes: full sets meet block by block, every pair once, and exact Jaccard decides. Of the links
    between two components in a block one comes out."""

    def fn(table: pa.Table) -> pa.Table:
        cls, comp, n, own = (table.column(c).to_numpy() for c in ("cls", "comp", "n", "own"))
        x, y = (table.column(c)[0].as_py() for c in "xy")
        sets = table.column("set").combine_chunks()
        values, rows = sets.flatten().to_numpy(), np.repeat(np.arange(len(cls), dtype=np.int32), np.diff(sets.offsets.to_numpy()))
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        shared = np.zeros((len(left), len(right)), np.float32)
        slices = -(-len(values) // ENTRIES)  # by value, so that the tables below stay small however long the texts are
        for part in range(slices):
            here = np.flatnonzero(values.view(np.uint64) % np.uint64(slices) == part)
            _, at, times = np.unique(values[here], return_inverse=True, return_counts=True)
            column = np.cumsum(times > 1) - 1  # what only one document here has is in no intersection
            common = times[at] > 1
            row, at = rows[here[common]], column[at[common]]
            order = np.argsort(at, kind="stable")
            row, at = row[order], at[order]
            for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
                a, b = np.searchsorted(at, [first, first + COLUMNS])
                held = np.zeros((len(cls), COLUMNS), np.float32)
                held[row[a:b], at[a:b] - first] = 1
                shared += held[left] @ held[right].T
        size = n.astype(np.float64)
        l, r = np.nonzero((100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)) & (comp[left][:, None] != comp[right][None, :]))
        a, b = left[l], right[r]
        ends = np.stack([np.minimum(comp[a], comp[b]), np.maximum(comp[a], comp[b])])
        one = np.unique(ends, axis=1, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(cls[a[one]], pa.int64()), "b": pa.array(cls[b[one]], pa.int64())})

    blocks = F.ceil(F.col("held") / BLOCK_OF_LIST).cast("long")
    dealt = groups.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    return dealt.select("grp", "x", "y", "own", "cls", "comp", "n", "set").groupBy("grp", "x", "y").applyInArrow(fn, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents are linked where 100 * common >= percent * union."""
    return _decided(docs, percent, Scratch(docs.sparkSession, "near")).drop("text_md5", "nameless")


def _decided(docs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``near_duplicates`` and the MD5 of each text: with the doc_id it names the rows that share a decision."""
    docs = id_and_text(docs)
    features = scratch.put("features", _features(docs))
    classes = scratch.put(
        "classes",
        features.filter("n_shingles > 0").groupBy("set_key")
        .agg(F.max(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least_doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .select(F.monotonically_increasing_id().alias("cls"), "set_key", "rep.doc_id", "rep.text_hash", "least_doc", "n", "sketch"),
    )

    # lists of retained values, each class under its rarest ones
    retained = classes.select("cls", "n", F.explode("sketch").alias("v"))
    common = retained.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    kept = F.least("n", F.lit(SKETCH))
    needed = F.least(F.lit(overlap(percent)), F.ceil(F.col("n") * percent / 100))
    listed = retained.join(common, "v").groupBy("cls").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("found"))
    n_keys = F.greatest(F.size("found") - needed + 1, F.lit(0)).cast("int")  # kept - needed + 1 rarest, of which kept - found are nobody else's
    rarest = F.transform(F.slice("found", 1, F.greatest(n_keys, F.lit(1))), lambda x: x["v"])
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda acc, x: acc + x["df"])  # the text that all near copies were made from holds the most common values
    index = scratch.put("index", listed.filter(n_keys > 0).select("cls", "n", weight.alias("weight"), F.explode(rarest).alias("v")))

    sizes_fit = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    by_hash, by_weight = F.struct(F.xxhash64("cls").alias("h"), "cls", "n"), F.struct("weight", F.xxhash64("cls").alias("h"), "cls", "n")
    centre = lambda c: F.struct(F.col(f"{c}.cls").alias("cls"), F.col(f"{c}.n").alias("n")).alias(c)
    centres = index.groupBy("v").agg(F.min(by_hash).alias("lo"), F.max(by_weight).alias("hi"), F.count("*").alias("held")).filter("held > 1").select("v", centre("lo"), centre("hi"))
    spokes = index.join(centres, "v").select("cls", "n", F.explode(F.array("lo", "hi")).alias("c"))
    stars = spokes.filter((F.col("cls") != F.col("c.cls")) & sizes_fit(F.col("n"), F.col("c.n"))).select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()
    wanted = scratch.put("wanted", index.select("cls").distinct().join(classes.select("cls", "doc_id", "text_hash"), "cls"))
    texts = scratch.put("texts", _texts(docs, wanted, wanted.count() <= BROADCAST_ROWS))
    tried = scratch.put("tried", _estimated(stars, classes, percent))
    links = scratch.put("links", _verified(tried, texts, percent))

    # lists that still hold several components
    labels = components(links, scratch, "first")
    labelled = index.join(labels, "cls", "left").select("v", "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    mixed = labelled.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).filter("lo < hi").select("v", "held")
    rest = scratch.put("rest", labelled.join(mixed, "v"))
    short = rest.filter(F.col("held") <= SHORT_LIST).drop("held")
    other = short.select("v", *(F.col(c).alias(f"{c}2") for c in ("cls", "n", "comp")))
    pairs = short.join(other, "v").filter((F.col("cls") < F.col("cls2")) & (F.col("comp") != F.col("comp2")) & sizes_fit(F.col("n"), F.col("n2"))).select(F.col("cls").alias("a"), F.col("cls2").alias("b")).distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti")
    more = scratch.put("more", _verified(_estimated(pairs, classes, percent), texts, percent))

    # Long lists of one group of near copies have nearly the same members: where lists hang together and one pass over their union is less work, the
    # union is compared, else each list by itself.
    long = scratch.put("long", rest.filter(F.col("held") > SHORT_LIST))
    lists = scratch.put("lists", long.groupBy("v").agg(F.min("cls").alias("first"), F.max("held").cast("double").alias("held")))
    unions = components(long.join(lists.select("v", "first"), "v").filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct(), scratch, "unions")
    unions = unions.select("cls", F.col("comp").alias("union"))
    in_union = long.select("cls", "n", "comp").distinct().join(unions, "cls")
    lists = lists.join(unions.withColumnRenamed("cls", "first"), "first")
    work = lists.groupBy("union").agg(F.sum(F.col("held") * F.col("held")).alias("work"))
    sizes = in_union.groupBy("union").agg(F.count("*").cast("double").alias("members")).join(work, "union")
    sizes = scratch.put("sizes", sizes.withColumn("whole", F.col("members") * F.col("members") <= F.col("work")))
    whole = in_union.join(sizes.filter("whole"), "union").select(F.concat(F.lit("u"), F.col("union")).alias("grp"), "cls", "n", "comp", F.col("members").alias("held"))
    alone = lists.join(sizes.filter("not whole"), "union").select("v")
    apart = long.join(alone, "v").select(F.concat(F.lit("v"), F.col("v")).alias("grp"), "cls", "n", "comp", F.col("held").cast("double").alias("held"))
    blocked = scratch.put("blocked", _block_links(whole.unionByName(apart).join(_sets(texts), "cls"), percent))
    labels = components(links.unionByName(more).unionByName(blocked), scratch, "second")

    of = classes.select("cls", "set_key", "least_doc").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = of.groupBy("comp").agg(F.min("least_doc").alias("least"))
    named = scratch.put("named", of.join(least, "comp").select("set_key", "least", F.when(F.col("least").isNull(), F.col("comp")).alias("nameless")))
    scratch.keep("features", "named")
    out = features.select("doc_id", "n_shingles", "set_key", "text_md5").join(named, "set_key", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "text_md5", "nameless").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The documents, all columns, one of each group. Rows that share a doc_id, or have none, are decided each by its own text; of rows with
    equal doc_id and text one stays, whatever their other columns; of a group without any doc_id the text with the least MD5 stays."""
    scratch = Scratch(docs.sparkSession, "near")
    found = scratch.put("found", _decided(docs, percent, scratch).select("doc_id", "text_md5", "kept", "nameless"))
    scratch.keep("found")
    nameless = found.filter("nameless is not null").select("nameless", "text_md5").distinct()
    chosen = nameless.groupBy("nameless").agg(F.min("text_md5").alias("chosen"))
    others = nameless.join(chosen, "nameless").filter("text_md5 <> chosen").select(F.lit(None).cast("long").alias("doc_id"), "text_md5")
    gone = found.filter(~F.col("kept")).select("doc_id", "text_md5").unionByName(others).select(F.col("doc_id").alias("gone"), F.col("text_md5").alias("gone_md5")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    md5 = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary")))
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone"]) & (md5 == gone["gone_md5"]), "left_anti")
    repeated = not found.groupBy("doc_id", "text_md5").count().filter("count > 1").isEmpty()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left
