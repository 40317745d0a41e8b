"""Importance resampling of documents towards the n-grams of a target corpus.

Every run of 1 to ``longest`` words is a feature and falls into a hashed bucket.  The gain
of a bucket is the scaled logarithm of its smoothed share in the target over its share in
the documents; a document weighs the gains of all its features.  Weights plus Gumbel noise
rank the documents, so that the highest ones are a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from carbonsplit.llm.common import cut
from carbonsplit.llm.ngram_table import cut_words, ngrams, pieces

BUCKETS = 10_000
LONGEST = 3


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all ``text`` per bucket; buckets without a feature have no row.

    Each task sums its own texts, so at most ``buckets`` rows of it are exchanged.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                for found in ngrams(part, longest):
                    used = found.table.used
                    np.add.at(sums, found.crc[used] % np.uint32(buckets), found.table.count[used])
        hit = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[hit])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket; the driver holds two numbers a bucket, whatever the tables' size."""

    def counts(texts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.float64)
        for row in bucket_counts(texts, longest, buckets).collect():
            out[row.bucket] = row.n
        return out

    s, t = counts(docs), counts(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), longest: int = LONGEST) -> DataFrame:
    """``keep``, ``n_words``, ``n_features`` and ``weight`` of every document: its occurrences gather the gains of their slots."""
    measured = ["n_words", "n_features", "weight"]
    read = docs.select(*keep, F.col("text").alias("_text"))
    schema = StructType(read.schema.fields[:-1] + [StructField(name, LongType()) for name in measured])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            out = np.zeros((3, len(texts)), np.int64)
            for first, part in pieces(texts):
                own = out[:, first : first + len(part)]
                own[0] = np.bincount(cut_words(part).text, minlength=len(part))
                for found in ngrams(part, longest):
                    # texts follow one another, so each one's occurrences are a run
                    starts = np.flatnonzero(np.diff(found.text, prepend=-1))
                    at = found.text[starts]
                    own[1, at] += np.diff(starts, append=len(found.text))
                    by_slot = gain[found.crc % np.uint32(len(gain))]
                    own[2, at] += np.add.reduceat(by_slot[found.table.slot], starts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, out)], schema=pa.schema([*list(batch.schema)[:-1], *((name, pa.int64()) for name in measured)]))

    return read.mapInArrow(weighed, schema)


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Scaled Gumbel noise of a document, the same in every run; a null id is written as nothing."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in a total order, from 1, without a task that sees them all.

    Range partitions are sorted on their own and written with each row's place there; the
    sizes of the partitions, one number each, give where a partition starts.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per shuffle partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    at = (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("long")
    return placed.join(F.broadcast(starts), "_part").withColumn(name, at).select(*rows.columns, name)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: int = 42,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``keep``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (null: not drawn) of every document.

    ``floor(percent * n / 100)`` of the n documents with ``min_words`` words or more are
    drawn, highest score first, ties to the smaller id (null last).  Words are runs of
    ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased; whole
    texts are read.  Null and empty texts have no features and weight 0; repeated rows are
    documents of their own, each with its rank; of ties in score and id the greater weight,
    then the greater number of features, goes first; empty ``docs`` give no rows, an empty
    ``target`` has every bucket empty; other columns do not matter.
    """
    gain = gains(docs, target, longest, buckets)
    found = weights(docs, gain, ("doc_id", *keep), longest)
    scored = cut(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = F.col("n_words") >= min_words
    drawn = scored.filter(able).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()]
    ranked = numbered(scored.filter(able), order, "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``docs``, unchanged."""
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return resample(rows, target, keep=("_row",), **options).filter("rank IS NOT NULL").select("_row.*")
