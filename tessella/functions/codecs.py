"""Digests, compression and encryption: built-in where Spark has them, else Arrow UDFs over batches."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.errors import InvalidInput, Unsupported


@F.pandas_udf(T.StringType())
def xxh3(data: pd.Series) -> pd.Series:
    """XXH3-64 as 16 hex digits: the value may be beyond a signed 64-bit number."""
    return data.map(lambda x: None if x is None else xxhash.xxh3_64_hexdigest(x))


@F.pandas_udf(T.StringType())
def sha3_256(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else hashlib.sha3_256(x).hexdigest())


@F.pandas_udf(T.StringType())
def blake2b_512(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else hashlib.blake2b(x).hexdigest())


def digest(name: str, data: Column) -> Column:
    known = {"sha256": lambda: F.sha2(data, 256), "sha512": lambda: F.sha2(data, 512), "sha3_256": lambda: sha3_256(data), "blake2b512": lambda: blake2b_512(data)}
    if name not in known:
        raise Unsupported(f"no implementation of {name} here")
    return known[name]()


def _zstd_fits(raw: bytes, packed: int, threshold: float) -> bool:
    return packed <= math.floor(len(raw) / threshold)


def _lz4_fits(raw: bytes, packed: int, threshold: float) -> bool:
    return packed > 0 and np.float32(len(raw)) / np.float32(packed) >= np.float32(threshold)


def compress(data: Column, name: str, level: int = 3, threshold: float = 1.05) -> Column:
    """The frame if it is worthwhile, else null."""
    if not math.isfinite(threshold) or threshold <= 0:
        raise InvalidInput(f"threshold {threshold}")
    if name not in ("zstd", "lz4"):
        raise Unsupported(name)

    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine, fits = zstandard.ZstdCompressor(level=level), _zstd_fits if name == "zstd" else _lz4_fits
        for batch in batches:
            packed = batch.map(lambda x: None if x is None else machine.compress(x) if name == "zstd" else pa.compress(x, codec="lz4", asbytes=True))
            yield pd.Series([None if p is None or not fits(x, len(p), threshold) else p for x, p in zip(batch, packed, strict=True)], dtype=object)

    return run(data)


def decompress(data: Column, size: Column, name: str) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for packed, n in batches:
            yield pd.Series([None if p is None else zstandard.decompress(p) if name == "zstd" else pa.decompress(p, int(k), codec="lz4", asbytes=True) for p, k in zip(packed, n, strict=True)], dtype=object)

    return run(data, size)


def seal(data: Column, key: bytes, nonce_hex: Column) -> Column:
    """AES-GCM: ciphertext and 16 bytes of tag. The key is a literal of the plan: keep plans private."""
    return F.substring(F.aes_encrypt(data, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(nonce_hex)), F.lit(13), F.octet_length(data) + 16)


def unseal(data: Column, key: bytes, nonce_hex: Column) -> Column:
    """Null if the key is wrong or the data were changed."""
    return F.try_aes_decrypt(F.concat(F.unhex(nonce_hex), data), F.lit(key), F.lit("GCM"))


def derive_key(password: bytes, salt: bytes, scheme: str = "pbkdf2", size: int = 32, cost: int = 310_000) -> bytes:
    """On the driver only."""
    if scheme == "pbkdf2":
        return hashlib.pbkdf2_hmac("sha256", password, salt, cost, size)
    if scheme == "scrypt":
        return hashlib.scrypt(password, salt=salt, n=1 << 14, r=8, p=1, dklen=size)
    raise Unsupported(scheme)
