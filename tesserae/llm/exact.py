"""Exact dedup with two Bloom passes, in DataFrame functions only.

Pass one counts how many rows set each bit of a Bloom filter and keeps the bits that were set at least
twice. A row is one small number there, and numbers are combined before they shuffle. Pass two looks up
every row: a row whose bit was set once only cannot have a copy and passes straight through; only the
others shuffle by their digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tesserae.llm._shared import Scratch, fresh, has_rows

#: Bits of the filter per row; only words of it with a bit that was set twice are kept, so its length costs nothing.
BITS_PER_ROW = 256
#: Words of the filter (64 MB as pairs of longs) and groups (about 128 MB) that are broadcast at a time; larger tables go part by part.
BROADCAST_WORDS, BROADCAST_GROUPS = 1 << 22, 1 << 20


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null counts as empty."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in " \t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _place(h: Column, bits: int) -> tuple[Column, Column]:
    """The word of the filter that a hash falls in, and the mask of its bit there."""
    at = h.bitwiseAND(F.lit(bits - 1).cast("long"))
    return F.shiftright(at, 6), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(word, set): the bits of a Bloom filter of ``bits`` bits (a power of two) that at least two rows of ``hashes`` (h long) set.

    Counts are combined before they shuffle, so a text with a third of all rows costs one row a task.
    """
    at = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    twice = hashes.groupBy(at.alias("at")).agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))


def looked_up(rows: DataFrame, key: Column, table: DataFrame, table_key: Column, on: Column, parts: int, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` left-joined with ``table`` by broadcasts of its ``parts``; the rows never shuffle.

    Equal keys fall in the same part. With several parts the rows are written once, a folder for each
    part, by the tasks that scan them; then every folder meets its own part of the table in a job of
    its own, so that one part at a time is in memory.
    """
    if parts == 1:
        return rows.join(F.broadcast(table), on, "left")
    part, own = fresh("part", [*rows.columns, *table.columns]), fresh("own", [*rows.columns, *table.columns])
    dealt = scratch.write_parts(rows.withColumn(part, F.pmod(F.xxhash64(key), F.lit(parts))), f"{name}-rows", part)
    held = scratch.write_parts(table.withColumn(own, F.pmod(F.xxhash64(table_key), F.lit(parts))), f"{name}-table", own)
    for i in range(parts):
        joined = dealt.where(F.col(part) == i).drop(part).join(F.broadcast(held.where(F.col(own) == i).drop(own)), on, "left")
        joined.write.mode("append").parquet(scratch.path(name))
    scratch.drop(f"{name}-rows", f"{name}-table")
    return scratch.spark.read.schema(joined.schema).parquet(scratch.path(name))


class Repeated:
    """Looks up which rows may have a copy."""

    def __init__(self, hashes: DataFrame, scratch: Scratch):
        self.scratch = scratch
        self.bits = 1 << max(6, (hashes.count() * BITS_PER_ROW).bit_length())
        self.words = scratch.write(repeated_filter(hashes, self.bits), "filter")
        self.parts = max(1, -(-self.words.count() // BROADCAST_WORDS))

    def flag(self, rows: DataFrame, h: str, name: str) -> DataFrame:
        """``rows`` with a boolean column ``name``: false only where no other row has the same hash in the column ``h``."""
        a, b = fresh("word", [*rows.columns, name]), fresh("set", [*rows.columns, name])
        word, mask = _place(F.col(h), self.bits)
        own = self.words.select(F.col("word").alias(a), F.col("set").alias(b))
        joined = looked_up(rows, word, own, F.col(a), word == F.col(a), self.parts, self.scratch, "flagged")
        return joined.withColumn(name, F.coalesce(F.col(b).bitwiseAND(mask) != 0, F.lit(False))).drop(a, b)


def _least(points: str, doc_id: str) -> Column:
    """Orders rows of equal texts: the most code points first, then the smallest id, and no id last."""
    return F.struct((-F.col(points)).alias("p"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size long, kept boolean, text_sha256 string), one row per input row.

    Texts are equal when identical after white space of [\\x20\\x09-\\x0D] is deleted; null counts as
    empty. Of equal texts the row with the most code points in its original text stays, then the
    smallest doc_id. Rows that repeat a doc_id with an equal text each count in group_size and are
    reported with the same answer. A null doc_id loses against any other; a group of null ids keeps null. An empty
    table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("sha"), F.char_length(text).cast("long").alias("points"))
    each = scratch.write(each.withColumn("h", F.xxhash64("sha")), "digests")  # two passes over digests, one over texts
    seen = Repeated(each.select("h"), scratch).flag(each, "h", "maybe")
    lone = seen.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    maybe = scratch.write(seen.where("maybe").select("doc_id", "sha", "points"), "maybe")
    best = maybe.groupBy("sha").agg(F.min(_least("points", "doc_id")).alias("best"), F.count("*").alias("group_size"))
    best = scratch.write(best.select("sha", F.col("best.id").alias("keep_id"), "group_size"), "best")
    rest = maybe.join(best, "sha").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return lone.unionByName(rest)


def keep_best(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`duplicates` keeps, with all their columns; repeats of a kept row are dropped too.

    Null and empty texts are equal to each other; null ids lose against others; an empty table gives an
    empty result; columns of any name pass through. Only digests of possibly repeated rows shuffle. Texts pass from the
    scan through a lookup of the groups, which says whether a row is alone, wins its group or loses;
    only rows that repeat the winner, id and length included, shuffle with their texts, one of each group and task.
    """
    scratch = Scratch(docs.sparkSession, "exact-keep")
    sha, points, key, times, other = (fresh(n, docs.columns) for n in ("sha", "points", "key", "times", "other"))
    digest = F.unhex(F.sha2(normalised(F.col(text_col)), 256))
    size = F.char_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long")
    digests = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("sha"), size.alias("points"))
    digests = scratch.write(digests.withColumn("h", F.xxhash64("sha")), "digests")
    maybe = Repeated(digests.select("h"), scratch).flag(digests, "h", "maybe").where("maybe")
    equal = maybe.groupBy("sha", _least("points", "id").alias("row")).agg(F.count("*").alias("times"))
    groups = equal.groupBy("sha").agg(F.min(F.struct("row", "times")).alias("best"), F.sum("times").alias("n")).where("n > 1")
    groups = scratch.write(groups.select(F.col("sha").alias(other), F.col("best.row").alias(key), F.col("best.times").alias(times)), "groups")
    parts = max(1, -(-groups.count() // BROADCAST_GROUPS))
    rows = looked_up(docs.withColumns({sha: digest, points: size}), F.col(sha), groups, F.col(other), F.col(sha) == F.col(other), parts, scratch, "kept")
    won = (F.col(f"{key}.p") == -F.col(points)) & F.col(f"{key}.id").eqNullSafe(F.col(id_col).cast("long"))
    kept = rows.where(F.col(key).isNull() | ((F.col(times) == 1) & won)).select(*docs.columns)
    if not has_rows(groups.where(F.col(times) > 1)):
        return kept
    return kept.unionByName(rows.where((F.col(times) > 1) & won).dropDuplicates([sha]).select(*docs.columns))
