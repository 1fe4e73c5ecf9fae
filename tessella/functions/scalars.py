"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bits of a chunk's flags.
FLAGS = {"error": 1, "compression": 2, "same_bytes": 4, "duplicate": 8, "encryption": 16, "empty_file": 32, "virtual": 64}
#: Codes of special files.
SPECIAL = {"fifo": 0, "char": 1, "block": 2, "socket": 3}
#: Digest lengths in bits.
DIGEST_BITS = {"blake2b512": 512, "sha256": 256, "sha512": 512, "sha3_256": 256, "blake3": 256}


def same_byte(data: Column) -> Column:
    """All bytes are equal; true for no bytes."""
    h = F.hex(data)
    return h == F.repeat(F.substring(h, 1, 2), F.octet_length(data))


def expand_same(byte_hex: Column, n: Column) -> Column:
    return F.unhex(F.repeat(byte_hex, n))


def pack_flags(**on: Column) -> Column:
    out = F.lit(0)
    for name, column in on.items():
        out = out.bitwiseOR(F.when(column, F.lit(FLAGS[name])).otherwise(F.lit(0)))
    return out


def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAGS[name])) != 0


def segment_extension(n: Column) -> Column:
    """z00, z01 … z99, z100 …"""
    text = n.cast("string")
    return F.concat(F.lit("z"), F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))



def segment_number(extension: Column) -> Column:
    return F.substring(extension, 2, 20).cast("long")


def makedev(major: Column, minor: Column) -> Column:
    """A device number: the minor's low byte in bits 0-7, twelve bits of the major from bit 8, the minor's other bits from bit 20."""
    bits = lambda x, keep, by: F.shiftleft(x.cast("long").bitwiseAND(F.lit(keep)), by)
    return bits(minor, 0xFF, 0).bitwiseOR(bits(major, 0xFFF, 8)).bitwiseOR(bits(minor, 0xFFFFFF00, 12))


def le_hex(value: Column, width: int = 8) -> Column:
    """The little-endian bytes of a whole number, as hex."""
    padded = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*[F.substring(padded, 2 * k + 1, 2) for k in reversed(range(width))])


def le_number(data: Column) -> Column:
    """An unsigned number from little-endian bytes, as DECIMAL(20,0): it may be beyond a signed 64-bit one."""
    h = F.hex(data)
    width = F.octet_length(data)
    turned = F.array_join(F.transform(F.sequence(width, F.lit(1), F.lit(-1)), lambda k: F.substring(h, 2 * k - 1, F.lit(2))), "")
    return F.when(width > 0, F.conv(turned, 16, 10).cast("decimal(20,0)"))


def nonce_hex(number: Column, padding: int) -> Column:
    """Twelve bytes: the number, little-endian, and four bytes of which the last names the kind of data."""
    return F.lower(F.concat(le_hex(number), F.lit("000000"), F.lit(f"{padding:02x}")))


def pax_nanoseconds(text: Column) -> Column:
    """Nanoseconds of a PAX time: digits with at most one point, either side may be empty; digits beyond the ninth are dropped, zeros before the first
    count nothing; null if malformed or too large."""
    whole = F.regexp_extract(text, r"^0*([0-9]*)", 1)
    part = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]*)$", 1), 1, 9), 9, "0")
    total = F.concat(F.when(whole == "", F.lit("0")).otherwise(whole), part).cast("decimal(38,0)")
    fine = text.rlike(r"^[0-9]*(\.[0-9]*)?$") & (F.length(whole) <= 20)
    return F.when(fine, F.when(total <= F.lit("18446744073709551615").cast("decimal(38,0)"), total))


def le_signed(data: Column) -> Column:
    """A signed number from up to 8 little-endian bytes."""
    width, n = F.octet_length(data), le_number(data)
    power = lambda less: F.element_at(F.array(*[F.lit(str(1 << (8 * k - less))).cast("decimal(38,0)") for k in range(1, 9)]), width)
    half, full, wide = power(1), power(0), n.cast("decimal(38,0)")
    return F.when(wide >= half, wide - full).otherwise(wide).cast("long")


def le_double(data: Column) -> Column:
    """A float from 8 little-endian bytes, by its sign, exponent and fraction."""
    bits = le_signed(data)
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF).cast("long"))
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1).cast("long"))
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    tiny = fraction.cast("double") * F.lit(2.0**-1074)
    scaled = (fraction + F.lit(1 << 52).cast("long")).cast("double") * F.pow(F.lit(2.0), (exponent - 1075).cast("double"))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0x7FF, special).when(exponent == 0, tiny).otherwise(scaled)


def platform_order(wide: Column, data: Column) -> Column:
    """Sorts platform strings: by kind, then by bytes."""
    return F.struct(wide.cast("int").alias("kind"), data.alias("bytes"))


def lossy_text(data: Column) -> Column:
    """UTF-8 with what is invalid replaced."""
    return F.make_valid_utf8(data.cast("string"))


def digest_bits(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in DIGEST_BITS.items() for x in kv]), F.lower(name))


def algorithm(name: Column) -> Column:
    """zstd, lz4 or none, in any case; null for others."""
    low = F.lower(name)
    return F.when(low.isin("zstd", "lz4", "none"), low)


def special_code(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, code in SPECIAL.items():
        out = out.when(kind == name, F.lit(code))
    return out


def as_hardlink(kind: Column, is_later_link: Column) -> Column:
    """Symlinks stay what they are."""
    return F.when(is_later_link & (kind != "symlink"), F.lit("hardlink")).otherwise(kind)


def acl_key(default: Column, kind: Column, qualifier: Column) -> Column:
    return F.concat_ws(":", F.when(default, F.lit("default")).otherwise(F.lit("access")), kind, F.coalesce(qualifier, F.lit("")))


def is_root_path(path: Column) -> Column:
    parts = F.filter(F.split(path, "/"), lambda x, i: (x != "") & ((x != ".") | (i == 0)))
    return F.size(parts) == 1


def le_text(data: Column, wide: Column) -> Column:
    """A platform's string, strictly: UTF-16LE or UTF-8; null if it isn't valid."""
    return F.when(wide, F.decode(data, "UTF-16LE")).otherwise(F.try_validate_utf8(data.cast("string")))


def checked_range(offset: Column, length: Column, total: Column) -> tuple[Column, Column]:
    """A read's start and size within total bytes; beyond the end there are none."""
    start = F.least(F.greatest(offset, F.lit(0)), total)
    return start, F.greatest(F.lit(0), F.least(length, total - start))


def seek(base: Column, total: Column, position: Column, by: Column) -> Column:
    """A new position from start, current or end; past the end is allowed, before the start is null."""
    to = F.when(base == "start", by).when(base == "current", position + by).otherwise(total + by)
    return F.when(to >= 0, to)
