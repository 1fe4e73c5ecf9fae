"""Operator 5: substring dedup by relative Lempel-Ziv parsing.

Documents are written once as compressed blocks; every block is a reference with an index of its word windows. Text that can repeat is
parsed greedily, left to right, against the blocks: at each word the factor begins at the earliest document of the block that holds the
window there and goes on, word by word, as far as both agree. A factor is (block, document, position, length), its words compared
themselves; words in no factor are literals. Windows that cross a factor's end are looked up on their own, so nothing is lost
where the parse changes its source, and the factors cover exactly the words of matched windows.

Blocks never meet in pairs. Two exchanges find which block to parse against: a block sends each distinct entry of its index once
to the bucket that the entry's hash names, with the smallest doc_id that holds it, and the bucket answers. The first exchange is of
anchors, the least 5-word hash in each window: a window that two documents share has an anchor that two documents share. The second is of
the windows with shared anchors, 64 bits and 32 more, and answers with the block of the smallest doc_id. Only that block's index can
matter for a window: any other holder is later. Runs of windows with one such block are the segments that are parsed
against it; equal segments are parsed once, and many segments for one block are dealt over several copies of it. So a
passage that a third of all rows share costs one entry and one segment a block.

Nulls and empty texts have no words (the digest of an empty string). A row with a null doc_id is left as it is and is
no source. Repeated rows with one doc_id don't remove each other's words. In ``dedupe`` and ``factors`` only doc_id and text are
read; ``cleaned`` keeps all columns, whatever their names."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, id_and_text
from tessella.llm.wordhash import buffers, hashes, mixed, rolled

WINDOW = 13
GRAM = 5
BLOCK_BYTES = 4 << 20
ENTRIES_PER_BUCKET = 1 << 17
SEGMENT_BYTES, SEGMENTS = 1 << 19, 1000  # for one copy of a block
BUCKET_BYTES = 1 << 28
SALTS = 16
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def _first_of_each(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class Block:
    """Words, windows and anchors of one block of documents."""

    def __init__(self, blob: bytes, id_column: str = "doc_id", text_column: str = "text"):
        self.batch = pa.ipc.open_stream(zstandard.decompress(blob)).read_next_batch()
        ids = self.batch.column(self.batch.schema.get_field_index(id_column))
        self.column = self.batch.column(self.batch.schema.get_field_index(text_column)).cast(pa.large_binary())
        self.flat, self.sizes = hashes(*buffers(self.column))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.known, self.ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0), np.int64)
        usable = np.where(self.known, np.maximum(self.sizes - WINDOW + 1, 0), 0)
        self.doc = np.repeat(np.arange(len(usable)), usable)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(usable) - usable, usable) + self.first[self.doc]
        self._words: dict[int, list[bytes]] = {}

    def text(self, doc: int) -> bytes:
        return self.column[doc].as_py() or b""

    def words(self, doc: int) -> list[bytes]:
        if doc not in self._words:
            if len(self._words) >= 64:
                self._words.clear()
            self._words[doc] = self.text(doc).split()
        return self._words[doc]

    def anchored(self) -> Block:
        """The distinct anchors in order, which of them two documents here hold, and the anchor of each window."""
        if len(self.at):
            grams, width = rolled(self.flat, GRAM, _B1), WINDOW - GRAM + 1
            least = grams[: len(grams) - width + 1].copy()
            for j in range(1, width):
                np.minimum(least, grams[j : j + len(least)], out=least)
            self.anchors, self.anchor_of = np.unique(mixed(least[self.at]), return_inverse=True)
            low, high = np.full(len(self.anchors), len(self.sizes)), np.full(len(self.anchors), -1)
            np.minimum.at(low, self.anchor_of, self.doc)
            np.maximum.at(high, self.anchor_of, self.doc)
            self.many = low < high
        else:
            self.anchors, self.anchor_of, self.many = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        return self

    def shared_windows(self, shared: np.ndarray) -> Block:
        """The distinct windows whose anchor is shared, in order of their hash, each with its smallest doc_id here."""
        self.candidate = np.flatnonzero(shared[self.anchor_of])
        at, owner = self.at[self.candidate], self.ids[self.doc[self.candidate]]
        key = rolled(self.flat, WINDOW, _B1)[at] if len(at) else np.zeros(0, np.uint64)
        check = (rolled(self.flat, WINDOW, _B2)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.lexsort((owner, check, key))
        key, check, owner = key[order], check[order], owner[order]
        new = _first_of_each(key, check)
        self.key, self.check, self.owner = key[new], check[new], owner[new]
        self.window_of = np.empty(len(key), np.int64)
        self.window_of[order] = np.cumsum(new) - 1
        return self

    def segments(self, own: int, earlier: np.ndarray, source: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(source block, document, first word, last word + 1) of each run of matched windows with one source. ``earlier``: the window begins
        in a smaller doc_id of the block ``source``; else it can only match a smaller doc_id of this block, ``own``."""
        w = self.window_of
        told = earlier[w]
        hit = told | (self.owner[w] < self.ids[self.doc[self.candidate]])
        at, doc, block = self.at[self.candidate[hit]], self.doc[self.candidate[hit]], np.where(told, source[w], own)[hit]
        edge = np.ones(len(at), bool)
        edge[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        begin = at[first] - self.first[doc[first]]
        yield from zip(block[first].tolist(), doc[first].tolist(), begin.tolist(), (begin + at[last] - at[first] + WINDOW).tolist(), strict=True)


class Reference:
    """A block as the source of factors: each distinct window with the place of its first occurrence in the smallest doc_id."""

    def __init__(self, block: Block):
        self.block = block
        key = rolled(block.flat, WINDOW, _B1)[block.at] if len(block.at) else np.zeros(0, np.uint64)
        order = np.lexsort((block.at, block.ids[block.doc], key))
        new = _first_of_each(key[order])
        self.key, self.window = key[order][new], order[new]

    def _agree(self, words: list[bytes], flat: np.ndarray, i: int, doc: int, at: int) -> int:
        """How many words from the i-th on equal those of the document from ``at`` on; hashes go ahead, words decide."""
        most = min(len(words) - i, int(self.block.sizes[doc]) - at)
        base, n, step = int(self.block.first[doc]) + at, 0, 64
        while n < most:
            to = min(most, n + step)
            differs = np.flatnonzero(flat[i + n : i + to] != self.block.flat[base + n : base + to])
            if len(differs):
                n += int(differs[0])
                break
            n, step = to, step * 2
        theirs = self.block.words(doc)
        if words[i : i + n] != theirs[at : at + n]:
            n = next(k for k in range(n) if words[i + k] != theirs[at + k])
        return n

    def parse(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Greedy factors (first word, length, doc_id, position in that document) of a segment; whatever they leave out is literal."""
        flat, _ = hashes(*buffers(pa.array([b" ".join(words)])))
        keys = rolled(flat, WINDOW, _B1)
        place = np.minimum(np.searchsorted(self.key, keys), max(0, len(self.key) - 1))
        known = self.key[place] == keys if len(self.key) else np.zeros(len(keys), bool)
        out, i = [], 0
        while i < len(keys):
            if known[i]:
                window = int(self.window[place[i]])
                doc = int(self.block.doc[window])
                at = int(self.block.at[window] - self.block.first[doc])
                n = self._agree(words, flat, i, doc, at)
                if n >= WINDOW:
                    out.append((i, n, int(self.block.ids[doc]), at))
                    i += n - WINDOW + 1  # windows over the factor's end are looked up on their own
                    continue
            i += 1
        return out


def _slices(ordered: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) where the top bits name the bucket."""
    names = (ordered >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.append(_first_of_each(names), True)) if len(names) else np.zeros(1, np.int64)
    return [(int(names[a]), a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def _answer(told: list | None, level: int, ordered: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits and the blocks that came back, in the order in which the entries were sent."""
    out, source, came = np.zeros(len(ordered), bool), np.full(len(ordered), -1, np.int64), {x["bucket"]: x for x in told or () if x["level"] == level}
    for k, a, b in _slices(ordered, bits):
        if k in came:
            hit = np.unpackbits(np.frombuffer(came[k]["bits"], np.uint8), count=b - a).astype(bool)
            out[a:b] = hit
            if level:
                source[a:b][hit] = np.frombuffer(zstandard.decompress(came[k]["sources"]), "<i8")
    return out, source


_MESSAGE = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("body", pa.binary())])
_REPLY = pa.schema([("block", pa.int64()), ("level", pa.int32()), ("bucket", pa.int64()), ("bits", pa.binary()), ("sources", pa.binary())])
_SEGMENT = pa.schema([("source", pa.int64()), ("segment", pa.binary()), ("words", pa.binary()), ("bytes", pa.int64()), ("block", pa.int64()), ("places", pa.binary())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _reply(table: pa.Table, level: int, sizes: list[int], hits: np.ndarray, sources: np.ndarray) -> pa.Table:
    rows, a = [], 0
    for block, bucket, n in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), sizes, strict=True):
        hit = hits[a : a + n]
        if hit.any():
            rows.append((block, level, bucket, np.packbits(hit).tobytes(), zstandard.compress(sources[a : a + n][hit].astype("<i8").tobytes(), 1) if level else b""))
        a += n
    return pa.Table.from_batches([_table(rows, _REPLY)])


def _shared_anchors(table: pa.Table) -> pa.Table:
    bodies = [np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("body").to_pylist()]
    every = np.concatenate(bodies)
    _, where, times = np.unique(every >> np.uint32(1), return_inverse=True, return_counts=True)
    shared = times > 1
    shared[where[every & np.uint32(1) > 0]] = True
    return _reply(table, 0, [len(x) for x in bodies], shared[where], every)


def _earlier_windows(table: pa.Table) -> pa.Table:
    keys, checks, owners = [], [], []
    for body in table.column("body").to_pylist():
        raw = zstandard.decompress(body)
        n = int.from_bytes(raw[:4], "little")
        keys.append(np.frombuffer(raw, "<u8", n, 4))
        checks.append(np.frombuffer(raw, "<u4", n, 4 + 8 * n))
        owners.append(np.frombuffer(raw, "<i8", 1, 4 + 12 * n)[0] + np.frombuffer(raw, "<i8" if raw[12 + 12 * n] else "<u4", n, 13 + 12 * n).astype(np.int64))
    sizes = [len(x) for x in keys]
    key, check, owner, block = np.concatenate(keys), np.concatenate(checks), np.concatenate(owners), np.repeat(table.column("block").to_numpy(), sizes)
    order = np.lexsort((block, owner, check, key))
    new = _first_of_each(key[order], check[order])
    of = np.cumsum(new) - 1
    least, source = owner[order][new][of], block[order][new][of]
    hits, sources = np.empty(len(key), bool), np.empty(len(key), np.int64)
    hits[order], sources[order] = least < owner[order], source
    return _reply(table, 1, sizes, hits, sources)


def _window_body(key: np.ndarray, check: np.ndarray, owner: np.ndarray) -> bytes:
    low = owner.min()
    wide = int(owner.max()) - int(low) >= 1 << 32
    return len(key).to_bytes(4, "little") + key.astype("<u8").tobytes() + check.astype("<u4").tobytes() + np.asarray([low], "<i8").tobytes() + bytes([wide]) + (owner - low).astype("<i8" if wide else "<u4").tobytes()


def _blocks(docs: DataFrame, text: str) -> DataFrame:
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ends = buffers(batch.column(at))[1][1:]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK_BYTES, "right")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as writer:
                    writer.write_batch(batch.slice(a, b - a))
                yield pa.RecordBatch.from_pydict({"block": [number], "bytes": [int(ends[b - 1] - (ends[a - 1] if a else 0))], "blob": [zstandard.compress(sink.getvalue().to_pybytes(), 3)]})
                a, number = b, number + 1

    return docs.mapInArrow(run, "block long, bytes long, blob binary")


def _each(rows: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            yield from work(row)


def _parsed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The blocks, and for each block with factors (block, found): found holds the places of its segments and the factors of each."""
    spark = docs.sparkSession
    blocks = scratch.put("blocks", _blocks(docs, "text"))
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    # in buckets, so that the joins by block below move what is told to a block, never the block
    blocks = scratch.put_by("block", max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES), "bucketed", blocks)
    scratch.drop("blocks")
    total = size // 6  # about as many words
    bits = min(40, max(6, int(total // 5 // ENTRIES_PER_BUCKET).bit_length()))

    def anchors(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row["blob"]).anchored()
        short = ((block.anchors << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
        body = (short & np.uint32(0xFFFFFFFE) | block.many).astype("<u4")
        yield _table([(k, row["block"], zstandard.compress(body[a:b].tobytes(), 1)) for k, a, b in _slices(block.anchors, bits)], _MESSAGE)

    def windows(row: dict) -> Iterator[pa.RecordBatch]:
        block = Block(row["blob"]).anchored()
        block.shared_windows(_answer(row["told"], 0, block.anchors, bits)[0])
        yield _table([(k, row["block"], zstandard.compress(_window_body(block.key[a:b], block.check[a:b], block.owner[a:b]), 1)) for k, a, b in _slices(block.key, bits)], _MESSAGE)

    def segments(row: dict) -> Iterator[pa.RecordBatch]:
        """Each distinct segment once, with the places (document, first word) that hold it."""
        block = Block(row["blob"]).anchored()
        block.shared_windows(_answer(row["told"], 0, block.anchors, bits)[0])
        found: dict[tuple[int, bytes], list] = {}
        for source, doc, a, b in block.segments(row["block"], *_answer(row["told"], 1, block.key, bits)):
            words = b" ".join(block.words(doc)[a:b])
            found.setdefault((source, hashlib.blake2b(words, digest_size=16).digest()), [words, []])[1].append((doc, a))
        yield _table([(source, name, zstandard.compress(words, 1), len(words), row["block"], np.asarray(places, "<i8").tobytes()) for (source, name), (words, places) in found.items()], _SEGMENT)

    def parse(row: dict) -> Iterator[pa.RecordBatch]:
        reference = Reference(Block(row["blob"]))
        out = [(row["block"], x["segment"], np.asarray(reference.parse(zstandard.decompress(x["words"]).split(b" ")), "<i8").tobytes()) for x in row["asked"]]
        yield _table(out, pa.schema([("source", pa.int64()), ("segment", pa.binary()), ("factors", pa.binary())]))

    message, reply = "bucket long, block long, body binary", "block long, level int, bucket long, bits binary, sources binary"
    over = lambda df, work, schema: df.mapInArrow(lambda rows: _each(rows, work), schema)
    with_told = lambda told: blocks.select("block", "blob").join(told.groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "bits", "sources")).alias("told")), "block", "left")
    first = scratch.put("anchors", over(blocks.select("block", "blob"), anchors, message).groupBy("bucket").applyInArrow(_shared_anchors, reply))
    second = scratch.put("windows", over(with_told(first), windows, message).groupBy("bucket").applyInArrow(_earlier_windows, reply))
    cut = scratch.put("segments", over(with_told(first.unionByName(second)), segments, "source long, segment binary, words binary, bytes long, block long, places binary"))
    distinct = cut.groupBy("source", "segment").agg(F.first("words").alias("words"), F.first("bytes").alias("bytes"))
    distinct = scratch.put("distinct", distinct)
    copies = distinct.groupBy("source").agg(F.ceil(F.greatest(F.sum("bytes") / SEGMENT_BYTES, F.count("*") / SEGMENTS)).cast("int").alias("copies"))
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a block with many segments is not one task's
    dealt = distinct.withColumn("salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int")).join(copies, ["source", "salt"]).withColumn("copy", F.pmod(F.xxhash64("segment", F.lit(1)), F.col("copies").cast("long")).cast("int"))
    asked = dealt.groupBy(F.col("source").alias("block"), "copy", "copies").agg(F.collect_list(F.struct("segment", "words")).alias("asked"))
    asked = scratch.put("asked", asked)
    one = blocks.select("block", "blob").join(asked.filter("copies = 1").select("block", "asked"), "block").select("block", "blob", "asked")
    held = asked.filter("copies > 1").groupBy("block").agg(F.first("copies").alias("copies"))
    copied = blocks.select("block", "blob").join(held, "block").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    many = copied.join(asked.filter("copies > 1").drop("copies"), ["block", "copy"]).select("block", "blob", "asked")
    parsed = scratch.put("parsed", over(one.unionByName(many), parse, "source long, segment binary, factors binary"))
    scratch.keep("bucketed", "segments", "parsed")
    placed = cut.select("source", "segment", "block", "places").join(parsed, ["source", "segment"])
    found = placed.filter(F.length("factors") > 0).groupBy("block").agg(F.collect_list(F.struct("source", "places", "factors")).alias("found"))
    return blocks, found


def _factors(block: Block, found: list | None) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """document -> its factors (first word, length, source block, doc_id, position), in order."""
    out: dict[int, list] = {}
    for x in found or ():
        factors = np.frombuffer(x["factors"], "<i8").reshape(-1, 4).tolist()
        for doc, a in np.frombuffer(x["places"], "<i8").reshape(-1, 2).tolist():
            out.setdefault(doc, []).extend((a + i, n, x["source"], of, at) for i, n, of, at in factors)
    return {doc: sorted(own) for doc, own in out.items()}


def _over_blocks(docs: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(block, factors of its documents) -> RecordBatch`` over all blocks."""
    scratch = Scratch(docs.sparkSession, "substring")
    blocks, found = _parsed(docs, scratch)

    def last(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(row: dict) -> Iterator[pa.RecordBatch]:
            block = Block(row["blob"])
            yield finish(block, _factors(block, row["found"]))

        return _each(rows, work)

    return blocks.select("block", "blob").join(found, "block", "left").mapInArrow(last, schema)


def _stays(n: int, factors: list) -> np.ndarray:
    """Which of n words are literal."""
    cover = np.zeros(n + 1, np.int64)
    for a, length, *_ in factors:
        cover[a] += 1
        cover[a + length] -= 1
    return np.cumsum(cover[:-1]) == 0


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, first, length, source_block, source_doc, source_first: every factor, in words. Factors may overlap by up to WINDOW - 1 words."""

    def finish(block: Block, found: dict) -> pa.RecordBatch:
        rows = [(int(block.ids[doc]), *f) for doc, own in found.items() for f in own]
        return _table(rows, pa.schema([(n, pa.int64()) for n in ("doc_id", "first", "length", "source_block", "source_doc", "source_first")]))

    return _over_blocks(id_and_text(docs), finish, "doc_id long, first long, length long, source_block long, source_doc long, source_first long")


def dedupe(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the literal words joined by one blank, and the runs of words that factors cover as first:length."""

    def finish(block: Block, found: dict) -> pa.RecordBatch:
        out = {"n_removed": [], "kept_sha256": [], "factors": []}
        for doc, n in enumerate(block.sizes.tolist()):
            words = block.text(doc).split()
            if doc in found:
                stays = _stays(n, found[doc])
                words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                edge = np.flatnonzero(np.diff(stays.astype(np.int8), prepend=1, append=1)).tolist()
                out["factors"].append(",".join(f"{a}:{b - a}" for a, b in zip(edge[::2], edge[1::2], strict=True)))
            else:
                out["factors"].append("")
            out["n_removed"].append(n - len(words))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        columns = [block.batch.column(0), pa.array(block.sizes), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["factors"], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])

    return _over_blocks(id_and_text(docs), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, factors string")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without the words of factors, which go with the white space before them; n_chars, if there, follows. Documents of which no word is left go."""
    names = docs.columns

    def finish(block: Block, found: dict) -> pa.RecordBatch:
        changed, gone = {}, set()
        for doc, own in found.items():
            stays = _stays(int(block.sizes[doc]), own)
            if not stays.any():
                gone.add(doc)
                continue
            text, pieces, end = block.text(doc), [], 0
            for m, stay in zip(_WORD.finditer(text), stays.tolist(), strict=True):
                if stay:
                    pieces.append(text[end : m.end()])
                end = m.end()
            changed[doc] = (b"".join(pieces) + text[end:]).decode(errors="replace")
        rows = [i for i in range(block.batch.num_rows) if i not in gone]
        batch = block.batch.take(pa.array(rows, pa.int64()))
        if not changed:
            return batch
        columns = dict(zip(names, batch.columns, strict=True))
        new = [changed[i] if i in changed else t for i, t in zip(rows, columns["text"].to_pylist(), strict=True)]
        columns["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) if i in changed else n for i, n, t in zip(rows, columns["n_chars"].to_pylist(), new, strict=True)], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return _over_blocks(docs, finish, docs.schema)
