"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash.  A source's budget is met by taking the
documents whose hash lies below a threshold.  The threshold is found from
histograms: sums by source and hash bucket give the bucket in which the budget
ends, only that bucket is looked at again with finer buckets, and so on until a
single hash value is left.  Nothing is sorted and no row is moved but the sums.
Thresholds are nested: a larger budget keeps all documents of a smaller one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut, word_count

#: The hash has LEVELS * STEP bits; each histogram resolves STEP of them.
LEVELS = 5
STEP = 12


def row_hash() -> Column:
    """60 bits of the MD5 of id and text."""
    content = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(content.cast("binary")), 1, LEVELS * STEP // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, hash``: words and the fixed hash of id and text."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("hash"))


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target``, one row per source.

    Sources in code point order, null last, get the weights in turn.  Together they
    get ``share`` times all words; none gets over ``most`` times its own, and what
    that leaves over goes to the others by weight.  The windows see one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("place", place).withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(float(most))
    everything = Window.partitionBy()
    by_need = Window.orderBy(cap / F.col("weight"), "place")
    level = (
        ranked.withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum(cap).over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("before")) / F.col("open_weight"))
        .withColumn("open", cap / F.col("weight") > F.col("level"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    return level.select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(cap).alias("target"))


def thresholds(sizes: DataFrame, target: DataFrame) -> DataFrame:
    """``target`` with ``rounds`` (whole copies of the source), ``edge`` and ``edge_taken``.

    One more copy of a document is taken if its hash is below ``edge``, or equals it
    and ``edge_taken``.  The taken sum is the one nearest to the budget among all
    sums up to a hash value; equal hashes (rows repeated in id and text) go together.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = target.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    state = cut(state.withColumn("edge", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-state")
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * STEP
        bucket = F.shiftright("hash", shift)
        known = state.select(F.col("source").alias("_source"), F.col("edge").alias("_edge"))
        inside = sizes.join(known, F.col("source").eqNullSafe(F.col("_source"))).filter(F.shiftright("hash", shift + STEP) == F.col("_edge"))
        sums = inside.groupBy(F.col("source").alias("_source"), bucket.alias("_bucket")).agg(F.sum("size").alias("_sum"))
        order = Window.partitionBy("_source").orderBy("_bucket")
        running = sums.withColumn("_upto", F.sum("_sum").over(order))
        found = (
            running.join(state.select("source", "rest", "below"), F.col("_source").eqNullSafe(F.col("source")))
            .filter(F.col("below") + F.col("_upto") > F.col("rest"))
            .groupBy("_source")
            .agg(F.min(F.struct("_bucket", "_upto", "_sum")).alias("_at"))
        )
        state = cut(
            state.join(found, F.col("source").eqNullSafe(F.col("_source")), "left").select(
                "source",
                "source_size",
                "target",
                "rounds",
                "rest",
                # a source without words has no such bucket and nothing to take
                F.coalesce("_at._bucket", F.shiftleft("edge", STEP)).alias("edge"),
                (F.col("below") + F.coalesce(F.col("_at._upto") - F.col("_at._sum"), F.lit(0))).alias("below"),
                F.coalesce(F.col("_at._sum"), F.lit(0)).alias("edge_sum"),
            ),
            "mix-state",
        )
    nearer = F.col("below") + F.col("edge_sum") / F.lit(2.0) <= F.col("rest")
    return state.select("source", "source_size", "target", "rounds", "edge", nearer.alias("edge_taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``doc_id, source, size, hash, source_size, target, copies, taken`` for every row of ``docs``.

    Null or empty text has size 0; a null source is a source of its own; a null id is
    hashed as "-"; rows repeated in id and text are taken alike; an empty table gives
    no rows; only ``doc_id``, ``text`` and ``source`` are read, other columns do not matter.
    The choice depends on the rows alone, so reruns agree.
    """
    sizes = cut(sized(docs), "mix-sizes")
    edges = thresholds(sizes, targets(sizes, weights, share, most)).withColumnRenamed("source", "_source")
    extra = (F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & F.col("edge_taken"))
    copies = F.col("rounds") + F.when(extra, 1).otherwise(0)
    return (
        sizes.join(edges, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "hash", "source_size", "target", copies.cast("int").alias("copies"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )



def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with all columns, once per copy; ``copy`` counts from 1."""
    chosen = (
        mix(docs, **options)
        .filter("copies > 0")
        .groupBy(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
        .agg(F.max("copies").alias("_copies"))
    )
    kept = [c for c in docs.columns if c != "copy"]
    rows = docs.select(F.struct(*kept).alias("_row"), F.col("doc_id").alias("_doc"), row_hash().alias("_own"))
    taken = rows.join(chosen, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select("_row.*", "copy")
