"""Fill-in-middle by overlapping chunks.

A text is cut into chunks that overlap by one character. Whether a unit ends between two characters shows
in those two alone, so chunks count their boundaries independently. Prefix sums of these counts tell which
chunk owns a boundary of a given rank, and only owning chunks are looked at again to place the cuts.
In UTF-8 the predicates read neighbouring bytes: a code point ends before every byte that continues none.
All texts of a batch give one table of chunks, so a very long text is many chunks and a short one a single.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tesserae.llm._shared import ship

ship(__name__)

#: Bytes of a chunk, without the one that it shares with the next.
CHUNK = 1 << 16
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 of these so many have the suffix first.
RATE, SPM = 90, 20


def _starts(a: np.ndarray) -> np.ndarray:
    return (a & 0xC0) != 0x80


def _space(a: np.ndarray) -> np.ndarray:
    return (a == 0x20) | ((a >= 0x09) & (a <= 0x0D))


#: Whether a unit ends between two neighbouring bytes.
UNITS = {
    "code point": lambda left, right: _starts(right),
    "word": lambda left, right: _space(left) & ~_space(right),
    "line": lambda left, right: left == 0x0A,
}


def chunks(begin: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of every chunk of texts given as [begin, end) of a buffer; a text of no bytes has none."""
    n = -(-(end - begin) // size)
    text = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    lo = begin[text] + nth * size
    return text, lo, np.minimum(lo + size, end[text])


def boundaries(data: np.ndarray, lo: int, hi: int, end: int, unit) -> np.ndarray:
    """The places in [lo, hi) of a text's bytes after which a unit ends; its last byte always ends one."""
    edge = min(hi + 1, end)
    found = unit(data[lo : edge - 1], data[lo + 1 : edge])
    return np.append(found, True) if edge == hi else found


def cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray, unit, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, lower rank, upper rank, bytes before the lower cut, bytes before the upper) of each text.

    The cuts follow first % (units + 1) and second % (units + 1) units.
    """
    text, lo, hi = chunks(begin, end, size)
    count = np.fromiter((np.count_nonzero(boundaries(data, a, b, end[t], unit)) for t, a, b in zip(text, lo, hi)), np.int64, len(text))
    upto = np.concatenate([[0], np.cumsum(count)])
    head = np.searchsorted(text, np.arange(len(begin) + 1))
    units = upto[head[1:]] - upto[head[:-1]]
    a, b = first % (units + 1), second % (units + 1)
    ranks = np.stack([np.minimum(a, b), np.maximum(a, b)])
    place = np.zeros_like(ranks)
    owner = np.searchsorted(upto, upto[head[:-1]] + ranks, "left") - 1  # the chunk in which the rank is reached
    for side, t in zip(*np.nonzero(ranks)):
        c = owner[side, t]
        nth = upto[head[t]] + ranks[side, t] - upto[c]
        place[side, t] = lo[c] + np.flatnonzero(boundaries(data, lo[c], hi[c], end[t], unit))[nth - 1] + 1 - begin[t]
    return units, ranks[0], ranks[1], place[0], place[1]


_CUT = "struct<units: bigint, low: bigint, high: bigint, at: bigint, to: bigint>"


def _cuts(unit: str):
    def placed(text: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        text = text.cast(pa.large_binary())
        _, offsets, data = text.buffers()
        at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(data or b"", np.uint8)
        got = cut(data, at[:-1], at[1:], first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False), UNITS[unit])
        return pa.StructArray.from_arrays([pa.array(g, pa.int64()) for g in got], ["units", "low", "high", "at", "to"])

    return F.arrow_udf(placed, _CUT, F.ArrowUDFType.SCALAR)


def _draw(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers from the SHA-256 of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, unit: str = "code point", rate: int = RATE, spm: int = SPM, seed: int = 1) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output): every text of ``docs`` cut at two drawn ranks.

    ``n`` and both counts are in units. The output of form plain is the text; psm is prefix, suffix, middle
    behind their marks; spm has the suffix first. Plain are empty texts, those that hold a mark, and those not
    drawn. Null texts are empty; a null id draws as ''; rows with one id and text come out alike, each on its
    own. Only ``doc_id`` and ``text`` are read, so other columns may have any name. Nothing shuffles.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    h = _draw(F.col("doc_id"), seed)
    cuts = _cuts(unit)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (h[2] % 100 >= rate)
    cut_rows = rows.select("doc_id", "text", cuts(F.col("text").cast("binary"), h[0], h[1]).alias("c"), F.when(plain, "plain").when(h[3] % 100 < spm, "spm").otherwise("psm").alias("form"))
    raw = F.col("text").cast("binary")
    at, to = F.col("c.at").cast("int"), F.col("c.to").cast("int")
    prefix, middle, suffix = F.substring(raw, F.lit(1), at), F.substring(raw, at + 1, to - at), F.substring(raw, to + 1, F.octet_length("text"))
    p, s, m = (F.lit(x).cast("binary") for x in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(raw)
    told = lambda c: F.when(F.col("form") != "plain", c)
    return cut_rows.select(
        "doc_id", "text", F.col("c.units").alias("n"), "form", told(F.col("c.low")).alias("prefix_chars"), told(F.col("c.high") - F.col("c.low")).alias("middle_chars"), output.cast("string").alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone: each mark stands in a transformed output once and can't arise at a seam."""
    raw, size = output.cast("binary"), F.octet_length(output)
    p, s, m = (_byte_of(output, x) for x in MARKS)
    part = lambda start, stop: F.substring(raw, start, stop - start)
    psm = F.concat(part(p + 3, s), part(m + 3, size + 1), part(s + 3, m))
    spm = F.concat(part(p + 3, m), part(m + 3, size + 1), part(s + 3, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(raw).cast("string")


def _byte_of(text: Column, mark: str) -> Column:
    """1 + the bytes before a mark."""
    return F.octet_length(F.substring_index(text, mark, 1)) + 1


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), one row per row of ``docs``."""
    t = transform(docs)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
