"""Token ids of whole texts by the tokenizers library, with a cache of words.

A pre-token of the two public BPE files never crosses the border between a character that is no
white space and ASCII white space. So a text falls into words whose ids can be cached and joined.
A word of plain characters is split by the file's own pattern and each part goes to the library's
BPE model; any other word goes to the library as a whole, and so does a whole text with unusual
white space. The file that drops space and lower-cases also allows to look up words in lower case
and the marks at their ends apart. Results equal ``Tokenizer.encode(text, add_special_tokens=False)``."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

WORD_FILE = "word_bpe_49k.json"
BYTE_FILE = "byte_bpe_50k.json"
CACHE_WORDS = 300_000  # in each generation of a cache, of about 120 bytes each; a cache has two, results don't depend on it
LONGEST_CACHED = 64

_BYTE_WORD = re.compile(rb"[ \t\n]*[^ \t\n]+|[ \t\n]+")
_UNEVEN = (b"  ", b"\n\n", b" \n", b"\n ", b"\t")
_ODD_ASCII = re.compile(rb"[\x0b-\x1f\x7f]")
_ODD_SPACE = re.compile(rb"[\x0b-\x1f\x7f]|\xc2[\x80-\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")
#: Characters for which Unicode versions, NFC and lower case leave no doubt.
_MARKS = frozenset(".,;:!?")
#: ASCII marks that always begin a pre-token of the word file after a letter or digit; an apostrophe may be part of 's.
_TAIL = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_LETTER_LAST = "[0-9a-zÀ-ÖØ-öø-įı-ž]$"
_PLAIN = re.compile("[\t\n\x20-\x7eÀ-įı-ž]+")


def _plain(letters: str) -> bool:
    return letters.isascii() or _PLAIN.fullmatch(letters) is not None


def _values(column: pa.StringArray) -> list[bytes]:
    """The values of a column without nulls that is no slice; to_pylist takes five times as long."""
    _, at, data = column.buffers()
    held = data.to_pybytes() if data else b""
    return [held[a:b] for a, b in pairwise(np.frombuffer(at, np.int32, len(column) + 1).tolist())] if len(column) else []


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Cache(dict):
    """key -> ids by ``make``. A full cache becomes the older generation and what is asked for again moves back, so frequent words stay."""

    def __init__(self, make: Callable[[str | bytes], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key: str | bytes) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got


class WordIds(_Cache):
    """word bytes -> its ids as little-endian bytes of ``width`` bytes each; ``after`` has a word's ids after a blank, or after the line end that it starts with."""

    def __init__(self, path: str, width: int = 4):
        spec = json.load(open(path, encoding="utf-8"))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.kind, self.code = self.tokenizer.model, np.dtype(f"<u{width}"), {2: "H", 4: "I"}[width]
        parts = spec["pre_tokenizer"].get("pretokenizers", [])
        self.drops_space = bool(parts)
        super().__init__(self.encoded_lower if parts else self.encoded)
        pattern = parts[0]["pattern"]["Regex"] if parts else public_tokenizers.PATTERN
        self.split = regex.compile(pattern)
        if not all(t["content"].startswith("<|") for t in spec["added_tokens"]):
            raise ValueError("added tokens must start with <|")
        table = dict(enumerate(byte_alphabet()))
        self.to_alphabet = lambda s: s.encode().decode("latin-1").translate(table)
        self.parts = _Cache(self.tokenized)
        self.after = _Cache(self.encoded_after)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def tokenized(self, s: str) -> bytes:
        shown = s.replace(" ", "\u0120") if s.isascii() and s.isprintable() else self.to_alphabet(s)
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def encoded(self, word: bytes) -> bytes:
        s = word.decode()
        if s.isalpha() and _plain(s):
            return self.tokenized(s)
        if s[-1] in _MARKS and s[:-1].isalpha() and _plain(s):
            return self[word[:-1]] + self[word[-1:]]
        if _PLAIN.fullmatch(s) and "<|" not in s:
            return b"".join(map(self.parts.__getitem__, self.split.findall(s)))
        return self.whole(s)

    def encoded_lower(self, word: bytes) -> bytes:
        """A word for the file that drops space and lower-cases: without A-Z and without ``<|``."""
        if word.isalpha():
            return array(self.code, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        s = word.decode()
        if s.isalpha() and _plain(s):
            low = s.lower()
            return self.tokenized(s) if low == s else self[low.encode()]
        if _PLAIN.fullmatch(s):
            return b"".join(map(self.parts.__getitem__, self.split.findall(s.lower())))
        return self.whole(s)

    def cased(self, word: bytes) -> bytes:
        """A word for the file that lower-cases; it finds added tokens before that."""
        return self.whole(word.decode()) if b"<|" in word else self[word.lower()]

    def encoded_after(self, word: bytes) -> bytes:
        s = word.decode()
        if s.isalpha() and _plain(s):
            return self.tokenized(" " + s)
        if s[-1] in _MARKS and s[:-1].isalpha() and _plain(s):
            return self.after[word[:-1]] + self[word[-1:]]
        return self.encoded(word if word[:1] == b"\n" else b" " + word)

    def ids(self, text: bytes | None) -> bytes:
        """The ids of one whole text; a null text is empty."""
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.cased, text.split()))
        if (_ODD_ASCII if text.isascii() else _ODD_SPACE).search(text):
            return self.whole(text.decode())
        if text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _UNEVEN):
            return b"".join(map(self.__getitem__, _BYTE_WORD.findall(text)))
        # single blanks and line ends: all words but the first have one before them, and a blank goes without saying
        first, *rest = text.replace(b"\n", b" \n").split(b" ")
        return self[first] + b"".join(map(self.after.__getitem__, rest))

    def column(self, texts: pa.StringArray, end: bytes) -> pa.BinaryArray:
        """``ids`` of each text and ``end`` after them. Equal words of the column are looked up once, where words are all that counts."""
        if not self.drops_space:
            return pa.array([self.ids(x) + end for x in texts.cast(pa.binary()).to_pylist()], pa.binary())
        texts = texts.fill_null("")
        cased = pc.any(pc.match_substring(texts, "<|")).as_py()
        words = pc.ascii_split_whitespace(texts if cased else pc.ascii_lower(texts))
        ends = words.offsets.to_numpy()
        coded = words.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        get = self.cased if cased else self.__getitem__
        bare = coded.dictionary if cased else pc.ascii_rtrim(coded.dictionary, _TAIL)
        stems = pc.if_else(pc.match_substring_regex(bare, _LETTER_LAST), bare, coded.dictionary).dictionary_encode()
        whole, own = _values(coded.dictionary), pc.binary_length(stems.dictionary).take(stems.indices).to_numpy().tolist()
        tails = pa.array([get(x[k:]) if k < len(x) else b"" for x, k in zip(whole, own, strict=True)], pa.binary())
        ids = pc.binary_join_element_wise(pa.array([*map(get, _values(stems.dictionary))], pa.binary()).take(stems.indices), tails, b"")
        ids = pa.concat_arrays([ids, pa.array([end], pa.binary())])
        ends = ends - ends[0]
        joined = ids.take(pa.array(np.insert(coded.indices.to_numpy(), ends[1:], len(ids) - 1)))
        offsets = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[ends + np.arange(len(ends))]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), joined.buffers()[2]])


_held: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, width: int = 4) -> WordIds:
    """One cache for each Python worker, kept from task to task."""
    if (path, width) not in _held:
        _held[path, width] = WordIds(path, width)
    return _held[path, width]


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
