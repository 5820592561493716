"""Functions that Spark has no built-in for: normal forms, exact rationals, compression."""

from __future__ import annotations

import gzip
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.workers import by_value

by_value(__name__)

#: Neither part of a rational may reach this; beyond it the value is refused, never rounded.
LIMIT = 1 << 95


def nfc(c: Column | str) -> Column:
    """Unicode NFC."""

    def norm(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return F.pandas_udf(norm, "string")(c)


def rational(op: str, a: Column | str, b: Column | str) -> Column:
    """'n/d' of two 'n/d' strings added, subtracted, multiplied or divided; null where undefined or too large."""

    def one(x: str | None, y: str | None) -> str | None:
        if x is None or y is None:
            return None
        try:
            p, q = Fraction(x), Fraction(y)
            r = {"add": lambda: p + q, "sub": lambda: p - q, "mul": lambda: p * q, "div": lambda: p / q}[op]()
        except (ZeroDivisionError, ValueError):
            return None
        return f"{r.numerator}/{r.denominator}" if max(abs(r.numerator), r.denominator) < LIMIT else None

    def run(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in frames:
            yield pd.Series([one(p, q) for p, q in zip(x, y)], dtype=object)

    run.__annotations__ = {"frames": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(a, b)


def unwrap_gzip(data: Column | str) -> Column:
    """The payload of gzip data; other data as it is, damaged gzip null."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in frames:
            yield s.map(_gunzip)

    return F.pandas_udf(run, "binary")(data)


def _gunzip(x: bytes | None) -> bytes | None:
    if x is None or not x.startswith(b"\x1f\x8b"):
        return x
    try:
        return gzip.decompress(x)
    except (OSError, EOFError):
        return None


def _zstd(data: Column | str, work: str, out: str, level: int, words: bytes | None) -> Column:
    # values stay in Arrow but for the one at work, and functions of one row share a worker, whatever their number
    def run(values: pa.Array) -> pa.Array:
        import zstandard

        known = zstandard.ZstdCompressionDict(words) if words else None
        pack, unpack = zstandard.ZstdCompressor(level=level, dict_data=known), zstandard.ZstdDecompressor(dict_data=known)

        def one(x):
            if x is None:
                return None
            if work != "unpack":
                y = pack.compress(x)
                return len(y) if work == "size" else y
            try:
                return unpack.decompress(x, max_output_size=MOST_UNPACKED)
            except zstandard.ZstdError:
                return None

        return pa.array((one(x.as_py()) for x in values), pa.int64() if work == "size" else pa.binary())

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, out)(data)


#: Bytes that a compressed value without a known size may grow to, and of a dictionary, at most.
MOST_UNPACKED, MOST_WORDS = 64 << 20, 64 << 10


def zstd(data: Column | str, level: int = 3, words: bytes | None = None) -> Column:
    """zstandard bytes, with a dictionary (``words``) if one is given."""
    if words and len(words) > MOST_WORDS:
        raise ValueError(f"a dictionary has at most {MOST_WORDS} bytes")
    return _zstd(data, "pack", "binary", level, words)


def unzstd(data: Column | str, words: bytes | None = None) -> Column:
    """What :func:`zstd` packed; null for damaged data or another dictionary's."""
    return _zstd(data, "unpack", "binary", 3, words)


def zstd_size(data: Column | str, level: int = 3) -> Column:
    """Bytes after zstandard compression."""
    return _zstd(data, "size", "long", level, None)
