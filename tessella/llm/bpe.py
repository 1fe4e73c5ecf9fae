"""Operator 10: byte-pair encoding and decoding by segment trees over adjacent pair ranks.

A tree's root is the lowest rank and, among equals, the leftmost pair. A merge changes at most
three leaves, each updated in logarithmic time, until the root says that no pair can be merged.
So a single word of n characters costs O(n log n), whatever its length.

A column of texts is cut into words and those into parts; equal ones are kept once. The trees of all
parts of up to 64 bytes stand side by side in one array and take their merges together, a merge of
each tree at a time; longer parts have trees of their own.

Nulls and empty texts have no ids (the digests of an empty string). Repeated rows each give a row; a
null doc_id stays null. Columns other than doc_id and text are ignored."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tessella.llm.common import id_and_text
from tessella.llm.token_store import _rows
from tessella.llm.tokens import CACHE_WORDS, LONGEST_CACHED, byte_alphabet

_NONE = 1 << 62
_LOW = (1 << 31) - 1
_FAR = np.int32((1 << 31) - 1)  # no pair, in the trees that stand side by side
_PLACES = 64  # bytes of a part in those
SLICE_BYTES = 1 << 24
TREES = 4096  # that take their merges together

#: Words for which Unicode versions, NFC and lower case leave no doubt.
_PLAIN = "^[\x21-\x7eÀ-įı-ž]*$"
_LETTERS = "^[a-zß-öø-įı-ž]+$"
#: Marks that always begin a part after a letter or digit, and end with it; an apostrophe may be part of 's.
_TAIL = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_LETTER_LAST = "[0-9a-zß-öø-įı-ž]$"


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


class SegmentTreeBpe:
    """Encoder and decoder for a word-level BPE file: NFC, white space to blanks, lower case, parts by
    the file's pattern, byte-level alphabet, an end mark on the last symbol of each part."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = (rank << 31, self.vocab[a + b])
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.alphabet = byte_alphabet()
        self.parts: dict[str, list[int]] = {}
        self._side_by_side()

    def _side_by_side(self) -> None:
        """The tables of ``many`` and ``column``. A pair's key is looked up from the place that its hash names onwards."""
        n = self.unused = max(self.token) + 1  # an id that no pair holds
        self.first = np.asarray([self.vocab[x] for x in self.alphabet], np.int32)
        self.last = np.asarray([self.vocab[x + self.end] for x in self.alphabet], np.int32)
        self.made = np.zeros(1 + max(rank >> 31 for rank, _ in self.pairs.values()), np.int32)
        bits = len(self.pairs).bit_length() + 2
        self.shift, self.steps = np.uint64(64 - bits), 0
        self.keys = np.full((1 << bits) + len(self.pairs), -1, np.int64)
        self.at = np.full(len(self.keys), _FAR, np.int32)
        keys = np.asarray([a * (n + 1) + b for a, b in self.pairs], np.int64)
        for key, home, (rank, made) in zip(keys.tolist(), self._hash(keys).tolist(), self.pairs.values(), strict=True):
            place = home
            while self.keys[place] >= 0:
                place += 1
            self.keys[place], self.at[place], self.made[rank >> 31] = key, rank >> 31, made
            self.steps = max(self.steps, place - home)
        self.decimals = pa.array([b" %d" % i for i in range(n)], pa.large_binary())
        self.strings = pa.array([b" " + self.token.get(i, "").encode() for i in range(n)], pa.large_binary())

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _FAR."""
        keys = a.astype(np.int64) * (self.unused + 1) + b
        place = self._hash(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.at[place], _FAR)
        left = np.flatnonzero((held != keys) & (held >= 0))
        for _ in range(self.steps):
            if not len(left):
                break
            place[left] += 1
            held = self.keys[place[left]]
            hit = held == keys[left]
            out[left[hit]] = self.at[place[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out

    def merged(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        pairs, size = self.pairs, 1 << (n - 2).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(n - 1):
            if found := pairs.get((ids[i], ids[i + 1])):
                tree[size + i] = found[0] | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, value: int) -> None:
            i = size + leaf
            tree[i] = value
            while i > 1:
                a, b = tree[i], tree[i ^ 1]
                i >>= 1
                least = a if a < b else b
                if tree[i] == least:
                    return
                tree[i] = least

        while (root := tree[1]) != _NONE:
            left = root & _LOW
            right = after[left]
            ids[left] = pairs[ids[left], ids[right]][1]
            ids[right] = -1
            beyond = after[left] = after[right]
            if right < n - 1:
                put(right, _NONE)
            found = None
            if beyond < n:
                before[beyond] = left
                found = pairs.get((ids[left], ids[beyond]))
            put(left, found[0] | left if found else _NONE)
            if (prior := before[left]) >= 0:
                found = pairs.get((ids[prior], ids[left]))
                put(prior, found[0] | prior if found else _NONE)
        return [x for x in ids if x >= 0]

    def part(self, s: str) -> list[int]:
        got = self.parts.get(s)
        if got is None:
            symbols = [self.alphabet[b] for b in s.encode()]
            symbols[-1] += self.end
            got = self.merged(list(map(self.vocab.__getitem__, symbols)))
            if len(s) <= LONGEST_CACHED:
                if len(self.parts) >= CACHE_WORDS:
                    self.parts.clear()
                self.parts[s] = got
        return got

    def cut(self, text: str) -> list[str]:
        """The parts of a text; an added token is a part as it stands, no other part equals one."""
        parts: list[str] = []
        for piece in self.at_special.split(text) if "<|" in text else (text,):
            if piece in self.special:
                parts.append(piece)
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece)
                piece = piece.lower() if piece.isascii() else "".join(map(str.lower, piece))
                parts += [piece] if piece.isascii() and piece.isalpha() else self.split.findall(piece)
        return parts

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for s in self.cut(text):
            ids += [self.special[s]] if s in self.special else self.part(s)
        return ids

    def decode(self, ids: list[int]) -> str:
        """As a file without a decoder decodes: tokens joined by a blank, special ones kept."""
        return " ".join(map(self.token.__getitem__, ids))

    def many(self, parts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, one part after the other, and how many each has. No part is empty or null."""
        _, at, data = parts.cast(pa.large_binary()).buffers()
        at = np.frombuffer(at, np.int64)[parts.offset : parts.offset + len(parts) + 1]
        held = np.frombuffer(data or b"", np.uint8)
        sizes = np.diff(at)
        alone = {}
        odd = pc.match_substring(parts, "<|").to_numpy(zero_copy_only=False)
        for k in np.flatnonzero((sizes > _PLACES) | odd).tolist():
            s = parts[k].as_py()
            alone[k] = [self.special[s]] if s in self.special else self.part(s)
        counts, done, least = np.zeros(len(parts), np.int64), [], 0
        sizes[list(alone)] = 0
        for places in (1, 2, 4, 8, 12, 16, 24, 32, _PLACES):
            own = np.flatnonzero((sizes > least) & (sizes <= places))
            least = places
            for i in range(0, len(own), TREES):
                which = own[i : i + TREES]
                n = sizes[which]
                ids = np.full((len(which), places + 2), self.unused, np.int32)
                inside = np.arange(places) < n[:, None]
                symbols = held[_ragged(at[which], n)]
                ids[:, 1:-1][inside] = self.first[symbols]
                ids[np.arange(len(which)), n] = self.last[held[at[which] + n - 1]]
                self._merge_all(ids, n)
                kept = ids[:, 1:-1][inside]
                kept, stays = kept[kept >= 0], (ids[:, 1:-1] >= 0) & inside
                counts[which] = stays.sum(1)
                done.append((which, kept))
        for k, got in alone.items():
            counts[k] = len(got)
            done.append((np.asarray([k]), np.asarray(got, np.int32)))
        ends = _ends(counts)
        out = np.empty(ends[-1], np.int32)
        for which, got in done:
            out[_ragged(ends[which], counts[which])] = got
        return out, counts

    def _merge_all(self, ids: np.ndarray, n: np.ndarray) -> None:
        """Merges each row's ids in place; what a merge takes up becomes -1. A row's ids are at 1 to n, the id of no token is at 0 and from n + 1 on."""
        trees, places = len(ids), ids.shape[1] - 2
        if places < 2 or not trees:
            return
        size = 1 << places.bit_length()  # leaf i is the pair that begins at place i
        wide, levels = places + 2, size.bit_length() - 1
        tree = np.full((trees, 2 * size), _FAR, np.int32)
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(trees, wide - 1)
        spots = np.arange(wide - 1, dtype=np.int32)
        tree[:, size : size + wide - 1] = np.where(rank == _FAR, _FAR, (rank << 7) | spots)
        k = size
        while k > 1:
            np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2], out=tree[:, k // 2 : k])
            k //= 2
        after = np.minimum(np.arange(1, wide + 1), (n + 1)[:, None]).astype(np.int32).ravel()
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int32), trees)
        ids, tree = ids.reshape(-1), tree.reshape(-1)
        row = np.arange(trees)
        while True:
            root = tree[row * (2 * size) + 1]
            on = root != _FAR
            if not on.all():
                row, root = row[on], root[on]
                if not len(row):
                    return
            base, top = row * wide, row * (2 * size)
            left = root & 127
            here = base + left
            right = after[here]
            beyond = after[base + right]
            made = self.made[root >> 7]
            ids[here] = made
            ids[base + right] = -1
            after[here] = beyond
            before[base + beyond] = left
            prior = before[here]
            found = self._rank(np.concatenate([made, ids[base + prior]]), np.concatenate([ids[base + beyond], made]))
            leaf = np.concatenate([left, prior])
            node = np.concatenate([leaf, right]).reshape(3, len(row)) + (top + size)
            tree[node[2]] = _FAR
            tree[node[:2].ravel()] = np.where(found == _FAR, _FAR, (found << 7) | leaf)
            local = node - top
            for _ in range(levels):
                local >>= 1
                child = 2 * local + top
                tree[local + top] = np.minimum(tree[child], tree[child + 1])

    def column(self, texts: pa.StringArray) -> Iterator[tuple[int, memoryview, memoryview]]:
        """Of each text: how many ids, the ids in decimal and the decoded text, both joined by blanks. Words never span ASCII white space."""
        words = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        ends = ends - ends[0]
        whole = coded.dictionary
        odd = pc.or_(pc.invert(pc.match_substring_regex(whole, _PLAIN)), pc.match_substring(whole, "<|"))
        low = pc.utf8_lower(pc.if_else(odd, "", whole))
        bare = pc.ascii_rtrim(low, _TAIL)
        stems = pc.if_else(pc.match_substring_regex(bare, _LETTER_LAST), bare, low).dictionary_encode()
        # units: the stems, then tails and odd words
        stem, tail = stems.indices.to_numpy().astype(np.int64), np.full(len(whole), len(stems.dictionary))
        letters = pc.match_substring_regex(stems.dictionary, _LETTERS).to_numpy(zero_copy_only=False)
        cuts: list[tuple[int, list[str]]] = [(k, self.split.findall(stems.dictionary[k].as_py())) for k in np.flatnonzero(~letters).tolist()]
        more: dict[str, int] = {"": len(stems.dictionary)}
        lengths = pc.binary_length(stems.dictionary).to_numpy()[stem]
        rows = np.flatnonzero(pc.binary_length(low).to_numpy() > lengths)
        if len(rows):
            tail[rows] = [more.setdefault(x.encode()[k:].decode(), len(stems.dictionary) + len(more)) for x, k in zip(low.take(rows).to_pylist(), lengths[rows].tolist(), strict=True)]
        cuts += [(k, [s] if s else []) for s, k in more.items()]
        n = len(stems.dictionary) + len(more)
        rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        stem[rows] = n + np.arange(len(rows))
        cuts += [(n + k, self.cut(x)) for k, x in enumerate(whole.take(rows).to_pylist())]
        n += len(rows)
        # parts: those of letters, which are stems as they are, then all others
        own: dict[str, int] = {}
        flat = [own.setdefault(s, len(own)) for _, parts in cuts for s in parts]
        known = np.flatnonzero(letters)
        sizes = np.zeros(n, np.int64)
        sizes[known] = 1
        for k, parts in cuts:
            sizes[k] = len(parts)
        place = _ends(sizes)
        index = np.empty(place[-1], np.int64)
        index[place[known]] = np.arange(len(known))
        names = np.asarray([k for k, _ in cuts], np.int64)
        index[_ragged(place[names], sizes[names])] = np.asarray(flat, np.int64) + len(known)
        every = pa.concat_arrays([stems.dictionary.take(known), pa.array(list(own), pa.large_string())]).dictionary_encode()
        ids, counts = self.many(every.dictionary)
        at, index = _ends(counts), every.indices.to_numpy()[index]
        ids = ids[_ragged(at[index], counts[index])]
        per = np.diff(_ends(counts[index])[place])
        at = _ends(per)
        order = coded.indices.to_numpy()
        totals = _ends((per[stem] + per[tail])[order])[ends]
        shown = []
        for table in (self.decimals, self.strings):
            made = table.take(pa.array(ids))
            starts = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1)[at]
            units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(starts), made.buffers()[2]])
            both = pc.binary_join_element_wise(units.take(pa.array(stem)), units.take(pa.array(tail)), pa.scalar(b"", pa.large_binary()))
            joined = both.take(coded.indices)
            shown.append((np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[ends].tolist(), memoryview(joined.buffers()[2] or b"")))
        (a, decimals), (b, strings) = shown
        for k, number in enumerate(np.diff(totals).tolist()):
            yield number, decimals[a[k] + 1 : a[k + 1]], strings[b[k] + 1 : b[k + 1]]


_held: dict[str, SegmentTreeBpe] = {}


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text of each whole document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _held:
            _held[path] = SegmentTreeBpe(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64)
            for a, b in _rows(sizes, SLICE_BYTES):
                names, texts = (c.slice(a, b - a) for c in batch.columns)
                numbers, ids, decoded = [], [], []
                for number, decimal, string in _held[path].column(texts):
                    numbers.append(number)
                    ids.append(hashlib.sha256(decimal).hexdigest())
                    decoded.append(hashlib.sha256(string).hexdigest())
                yield pa.RecordBatch.from_arrays([names, pa.array(numbers, pa.int64()), pa.array(ids), pa.array(decoded)], schema=schema)

    return id_and_text(docs).mapInArrow(fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
