"""The bounded sample of labelled texts on which the classifiers are trained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(modulus: int, remainder: int):
    """True for the documents whose label is not learned from: crc32 of the id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def usable_labels(labels: DataFrame, label: str, modulus: int, remainder: int) -> DataFrame:
    """``_id, _label``: one row per labelled id that may be learned from; of repeated rows the largest label counts."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(modulus, remainder))
    return usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).cast("int").alias("_label"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: dict[int, int]) -> list[tuple[str, int]]:
    """``(text, label)`` of at most ``per_class[label]`` labelled documents for each label.

    The choice is by a hash of the id, so it does not change between runs.  Rows with a
    null id or label take no part; of repeated label rows for an id the largest counts;
    null texts are empty.  The rows come to the driver, so ``per_class`` is their bound.
    """
    known = usable_labels(labels, label, modulus, remainder).withColumn("_order", F.xxhash64("_id"))
    chosen = [known.filter(F.col("_label") == value).orderBy("_order", "_id").limit(n).drop("_order") for value, n in per_class.items()]
    # at most sum(per_class) ids and integers
    picked = F.broadcast(chosen[0].unionAll(chosen[1]))
    rows = docs.join(picked, docs["doc_id"] == F.col("_id")).groupBy("_id", "_label").agg(F.max(F.coalesce("text", F.lit(""))).alias("_text"))
    return [(r._text, r._label) for r in sorted(rows.collect(), key=lambda r: r._id)]
