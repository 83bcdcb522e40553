"""Bounded samples of labelled rows, and the folds that keep held-out rows out of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import staged

#: Hash values that a sample's threshold is drawn from.
RANGE = 1 << 30
#: Bytes of text that a sample may bring to the driver, shared evenly by the classes.
MOST_BYTES = 24 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id has the fold of the empty text, 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def by_class(rows: DataFrame, label: str, most: int, *keys: str, together: bool = False) -> tuple[DataFrame, dict]:
    """About ``most`` rows of each class at most (``together``: of all classes, an equal number each), taken by a hash of ``keys``: all rows of smaller classes, a share of larger ones; and how many rows each class has.

    The classes are labels, of which there are few; only their counts come to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if together:
        most = max(1, most // max(1, len(counts)))
    place = F.pmod(F.xxhash64(*keys), F.lit(RANGE))
    limit = F.lit(0)
    for value, n in counts.items():
        limit = F.when(F.col(label) == F.lit(value), F.lit(RANGE if n <= most else RANGE * most // n)).otherwise(limit)
    return rows.where(place < limit), counts


def within_bytes(sample: DataFrame, label: str, text: str, classes: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of a sample, which is stored first, in the order of their texts' hashes, while a class has used less than its share of ``most_bytes``.

    A text that alone is beyond the share is left out. The sample has few rows, so that a class may be one task's.
    """
    kept = staged(sample, "sample").withColumn("_size", F.octet_length(text).cast("long")).where(F.col("_size") <= most_bytes // max(1, classes))
    w = Window.partitionBy(label).orderBy(F.xxhash64(text), text).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("_used", F.sum("_size").over(w)).where(F.col("_used") <= most_bytes // max(1, classes)).drop("_size", "_used")


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(_id, _label, _text): about ``per_class`` labelled rows of each class and at most ``most_bytes`` of text, none of the held-out fold; and how many labelled rows each class has.

    The sample's ids, so bounded, are broadcast to find the texts. Where ids stand on many rows, a share of the rows is taken.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col("_id").isNotNull())
    marked, counts = by_class(marked.where(fold("_id", folds) != held).distinct(), "_label", per_class, "_id")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found, _ = by_class(texts.join(F.broadcast(marked), "_id"), "_label", per_class * 2, "_id", "_text")
    return within_bytes(found.select("_id", "_label", "_text"), "_label", "_text", len(counts), most_bytes), counts
