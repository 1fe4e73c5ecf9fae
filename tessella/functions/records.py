"""Records in bytes: little-endian values, strings, lists, maps, tagged values, and records with magic, length and version.

A value is described by a kind: ``u8`` to ``u64``, ``i8`` to ``i64``, ``f32``, ``f64``, ``bool``, ``string``, ``bytes``, ``platform`` (a string
of a platform, as (wide, bytes)), ``[kind]`` for a list, ``{kind: kind}`` for a map (encoded in the order of its keys), ``any`` for a value with
its tag before it. Decoding never allocates what the bytes can't hold: a length beyond the end is an EncodingFault."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.errors import EncodingFault, InvalidInput, Unsupported

#: Numbers in little-endian order.
NUMBERS = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i8": "b", "i16": "h", "i32": "i", "i64": "q", "f32": "f", "f64": "d", "bool": "?"}
#: Tags of values that carry their kind.
TAGS = {
    "u8": 0x00, "u16": 0x01, "u32": 0x02, "u64": 0x03, "i8": 0x04, "i16": 0x05, "i32": 0x06, "i64": 0x07, "string": 0x08,
    "hashmap": 0x09, "map": 0x0A, "bytes": 0x0B, "f32": 0x0C, "f64": 0x0D, "list": 0x0E, "bool": 0x0F, "platform": 0xFB,
}
_KINDS = {v: k for k, v in TAGS.items()}
DEEPEST = 64


@dataclass(frozen=True)
class Tagged:
    """A value together with its kind; lists hold Tagged, maps go from text to Tagged."""

    kind: str
    value: object


def encode(kind, value) -> bytes:
    if isinstance(kind, list):
        return encode("u64", len(value)) + b"".join(encode(kind[0], x) for x in value)
    if isinstance(kind, dict):
        (k, v), = kind.items()
        return encode("u64", len(value)) + b"".join(encode(k, a) + encode(v, b) for a, b in sorted(value.items()))
    if kind in NUMBERS:
        try:
            return struct.pack("<" + NUMBERS[kind], value)
        except struct.error as e:
            raise EncodingFault(f"{value} as {kind}: {e}") from None
    if kind == "string":
        raw = value.encode()
        return encode("u64", len(raw)) + raw
    if kind == "bytes":
        return encode("u64", len(value)) + bytes(value)
    if kind == "platform":
        wide, raw = value
        return encode("u8", int(wide)) + encode("bytes", raw)
    if kind == "any":
        inner = {"list": ["any"], "hashmap": {"string": "any"}, "map": {"string": "any"}}.get(value.kind, value.kind)
        return encode("u8", TAGS[value.kind]) + encode(inner, value.value)
    raise Unsupported(str(kind))


class Reader:
    """Reads values one after the other."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.end - self.at:
            raise EncodingFault(f"{n} bytes wanted at {self.at}, {self.end - self.at} left")
        self.at += n
        return bytes(self.data[self.at - n : self.at])

    def size(self, least: int) -> int:
        """A count of entries, of ``least`` bytes each at the least."""
        n = self.read("u64")
        if n * least > self.end - self.at:
            raise EncodingFault(f"{n} entries don't fit {self.end - self.at} bytes")
        return n

    def read(self, kind, depth: int = 0):
        if depth > DEEPEST:
            raise EncodingFault("nested too deeply")
        if isinstance(kind, list):
            return [self.read(kind[0], depth + 1) for _ in range(self.size(1))]
        if isinstance(kind, dict):
            (k, v), = kind.items()
            return {self.read(k, depth + 1): self.read(v, depth + 1) for _ in range(self.size(2))}
        if kind == "bool":
            return self.take(1) != b"\0"
        if kind in NUMBERS:
            return struct.unpack("<" + NUMBERS[kind], self.take(struct.calcsize("<" + NUMBERS[kind])))[0]
        if kind == "string":
            try:
                return self.take(self.size(1)).decode()
            except UnicodeDecodeError as e:
                raise EncodingFault(f"no text: {e}") from None
        if kind == "bytes":
            return self.take(self.size(1))
        if kind == "platform":
            flag = self.read("u8")
            if flag > 1:
                raise EncodingFault(f"string encoding {flag}")
            return bool(flag), self.read("bytes")
        if kind == "any":
            tag = self.read("u8")
            if tag not in _KINDS:
                raise Unsupported(f"unknown tag {tag:#04x}")
            own = _KINDS[tag]
            inner = {"list": ["any"], "hashmap": {"string": "any"}, "map": {"string": "any"}}.get(own, own)
            return Tagged(own, self.read(inner, depth + 1))
        raise Unsupported(str(kind))


def encode_keyed(key: str, kind, value) -> bytes:
    """The key's length in one byte, the key, the value."""
    raw = key.encode()
    return encode("u8", len(raw)) + raw + encode(kind, value)


def decode_keyed(reader: Reader, key: str, kind):
    got = reader.take(reader.read("u8"))
    if got != key.encode():
        raise EncodingFault(f"key {got!r} where {key!r} is expected")
    return reader.read(kind)


def raw_bytes(value: Tagged) -> bytes | None:
    """A plain value's bytes alone, text and bytes without their length; nested values have none."""
    if value.kind in ("list", "map", "hashmap"):
        return None
    if value.kind == "string":
        return value.value.encode()
    if value.kind == "bytes":
        return bytes(value.value)
    return value.value[1] if value.kind == "platform" else encode(value.kind, value.value)


def platform_text(value: tuple[bool, bytes], lossy: bool = False) -> str | None:
    """A platform string as text; strictly, null if it is none."""
    wide, raw = value
    try:
        return raw.decode("utf-16-le" if wide else "utf-8", "replace" if lossy else "strict")
    except UnicodeDecodeError:
        return None


@dataclass(frozen=True)
class Layout:
    """A record: magic (big-endian), length of all that follows and of what came before it, version, fields in order."""

    name: str
    magic: int
    version: int
    fields: tuple[tuple[str, object], ...]

    def encode(self, **values) -> bytes:
        body = encode("u8", self.version) + b"".join(encode(kind, values[name]) for name, kind in self.fields)
        return struct.pack(">I", self.magic) + encode("u64", 12 + len(body)) + body

    def decode(self, data: bytes, at: int = 0) -> dict:
        if at < 0 or at + 13 > len(data):
            raise EncodingFault(f"no room for a {self.name} at {at}")
        if struct.unpack_from(">I", data, at)[0] != self.magic:
            raise InvalidInput(f"no {self.name} at {at}")
        n = struct.unpack_from("<Q", data, at + 4)[0]
        if n < 13 or n > len(data) - at:
            raise EncodingFault(f"a {self.name} of {n} bytes at {at}")
        reader = Reader(data, at + 12, at + n)
        version = reader.read("u8")
        if version != self.version:
            raise Unsupported(f"{self.name} of version {version}")
        return {name: reader.read(kind) for name, kind in self.fields}


_MAP = {"u64": "u64"}
#: Magic, version and order of fields.
SEGMENT_HEADER = Layout("segment header", 0x7A66666D, 3, (("unique_identifier", "u64"), ("segment_number", "u64"), ("chunkmap_size", "u64")))
SEGMENT_FOOTER = Layout(
    "segment footer", 0x7A666646, 3,
    (("length_of_segment", "u64"), ("object_headers", _MAP), ("object_footers", _MAP), ("chunk_headers", _MAP), ("same_bytes", _MAP), ("duplicates", _MAP), ("first_chunk_number", "u64"), ("footer_offset", "u64")),
)


def open_segment(data: bytes) -> tuple[dict, dict]:
    """Header and footer of a segment. The footer's place is in the last eight bytes; of a last segment those belong to the container's own
    footer, which the segment's footer, with its place at its end, comes right before."""
    header = SEGMENT_HEADER.decode(data)
    if len(data) < 8:
        raise EncodingFault("too short for a footer")
    at = struct.unpack("<Q", data[-8:])[0]
    try:
        return header, SEGMENT_FOOTER.decode(data, at)
    except (InvalidInput, EncodingFault):
        if at < 8 or at > len(data):
            raise EncodingFault(f"no footer at {at}") from None
        return header, SEGMENT_FOOTER.decode(data, struct.unpack("<Q", data[at - 8 : at])[0])


def next_header(header: dict) -> dict:
    return header | {"segment_number": header["segment_number"] + 1}


def payload(file_type: str, children: list[int] = (), target: tuple[bool, bytes] | None = None, link_to: int = 0, rdev: int = 0, code: int = 0) -> bytes:
    """What is stored for an entry that is no regular file: a directory's children, a symlink's target, a hardlink's file, a device."""
    if file_type == "directory":
        return encode(["u64"], list(children))
    if file_type == "symlink":
        return encode("platform", target)
    return encode("u64", link_to) if file_type == "hardlink" else encode("u64", rdev) + encode("u8", code)


def over(fn, returns: str):
    """An Arrow UDF from ``fn`` of plain values; a row that is null, or that doesn't decode, gives null."""

    def one(*row):
        if any(x is None for x in row):
            return None
        try:
            return fn(*row)
        except (EncodingFault, InvalidInput, Unsupported):
            return None

    @F.pandas_udf(returns)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)  # a single argument comes bare
            yield pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def string_list(column: Column) -> Column:
    """A list of texts in bytes, and so a built-in expression: no Python."""
    from tessella.functions.scalars import le_hex

    text = lambda s: F.concat(le_hex(F.octet_length(s).cast("long")), F.hex(F.encode(s, "UTF-8")))
    return F.unhex(F.concat(le_hex(F.size(column).cast("long")), F.array_join(F.transform(column, text), "")))
