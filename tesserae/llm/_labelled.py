"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from tesserae.llm._shared import Scratch


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as fold 0's text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


#: Bytes of text of each class in a sample, at most; a first text counts whatever its size.
SAMPLE_BYTES = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``most`` labelled documents of each class outside the held-out fold, in id-hash order.

    Only the ids and labels are ranked; at most 2 * ``most`` ids are broadcast and as many whole texts written, of
    which those are gathered that fit in SAMPLE_BYTES of their class. Labels that are null are skipped; of several labels of one document the greatest counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_label"))
    order = F.xxhash64("_id", F.lit(11))
    picked = [known.where(F.col("_label") == y).orderBy(order, "_id").limit(most) for y in (0, 1)]
    ids = picked[0].unionByName(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    # few rows: they are written with their sizes, and only so many bytes of them come to the driver
    rows = Scratch(docs.sparkSession, "sample").write(rows.select("doc_id", "text", "_label", order.alias("_order"), F.octet_length("text").cast("long").alias("_size")), "rows")
    by_id = rows.groupBy("_label", "_order", "doc_id").agg(F.sum("_size").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy("_label").orderBy("_order", "doc_id")) - F.col("_size")
    fits = by_id.withColumn("_before", before).where((F.col("_before") == 0) | (F.col("_before") + F.col("_size") <= SAMPLE_BYTES)).select("doc_id")
    got = rows.join(F.broadcast(fits), "doc_id", "left_semi").select("doc_id", "text", "_label").toArrow()
    return sorted({r["doc_id"]: (r["doc_id"], r["text"], r["_label"]) for r in got.to_pylist()}.values())
