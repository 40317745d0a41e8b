"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut

SEED = 42
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of the word shingles; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = itertools.chain((0,), (ends[: n - 1] + 1).tolist())
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = (digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True))
    counts = np.zeros(64, np.int64)
    while len(part := np.fromiter(itertools.islice(hashes, _CHUNK), np.uint64)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_of(text: Column, shingle: int) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return hashed(text)


def ball(value: Column, radius: int) -> Column:
    """All variants of a fingerprint within ``radius`` bits, itself included."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: m.bitwiseXOR(value))


def links(fingerprints: DataFrame, radius: int) -> DataFrame:
    """``a, b``: edges that connect all ``fingerprint`` values within ``radius`` bits.

    Two values within ``radius`` share a variant half way.  All values that share a
    variant lie within ``radius`` of each other, so each is linked with the smallest of
    them and no pairs are formed.  A variant has as many values as its ball has points
    at most (65 for one bit), whatever the data.
    """
    if radius % 2:
        raise ValueError("ball hashing needs an even radius")
    emitted = fingerprints.select("fingerprint", F.explode(ball(F.col("fingerprint"), radius // 2)).alias("variant"))
    met = emitted.withColumn("a", F.min("fingerprint").over(Window.partitionBy("variant"))).filter("a <> fingerprint")
    pairs = met.select("a", F.col("fingerprint").alias("b")).distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node of each component, for nodes that have an edge.

    Every round takes the smallest label among the neighbours and then the label's own
    label, which halves the way to the smallest node.  Nodes have at most as many edges
    as the ball has points, so only the jump joins on a frequent label; it joins two
    written tables, whose hot keys Spark splits.  Rounds go on until no label changes.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")), "edges")
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
        least = near.groupBy("node").agg(F.min("seen").alias("seen"))
        hooked = cut(labels.join(least, "node").select("node", F.least("label", "seen").alias("label"), F.col("label").alias("old")), "labels")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = cut(hooked.join(up, "label").select("node", F.least("label", "up").alias("label"), "old"), "labels")
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits), ``component_id``, ``label`` and ``keep``, one row per document.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A fingerprint bit
    is 1 if set in over half of the XXH64 values of the shingles, repeats included; a text
    of fewer words is one shingle; null and empty texts have fingerprint zero and are
    linked like any other.  Fingerprints within ``radius`` bits are linked;
    ``component_id`` is the smallest id that links reach (null if all ids there are null),
    ``label`` the smallest fingerprint there, which tells components without ids apart.
    Equal texts and repeated rows meet in one fingerprint before anything is joined;
    empty tables give no rows; only ``doc_id``, ``text`` and ``keep`` are read.
    """
    read = cut(docs.select("doc_id", *keep, fingerprint_of(F.col("text"), shingle).alias("fingerprint")), "fingerprints")
    nodes = cut(read.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "nodes")
    labels = components(links(nodes, radius))
    named = nodes.join(labels.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    named = cut(named.withColumn("label", F.coalesce("label", "fingerprint")), "named")
    first = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    # most labels stand for one fingerprint; a large component's label is joined from written tables
    found = cut(named.select("fingerprint", "label").join(cut(first, "firsts"), "label"), "found")
    joined = read.join(found, "fingerprint")
    return joined.select("doc_id", *keep, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "label")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay if each component keeps one, all columns unchanged.

    The smallest id stays (an id before none), then the smallest hash of the text; of
    rows repeated in id and text one stays.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))
    return first_of_each(docs, near_duplicates(keyed, shingle, radius, keep=("text_key",)))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, given ``doc_id, text_key, label`` of each."""
    kept = docs.columns
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    repeats = found.groupBy("label", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    chosen = cut(repeats.groupBy("label").agg(F.min(order).alias("one"), F.min_by("times", order).alias("times")), "chosen")
    one = chosen.select(F.col("one.doc_id").alias("_id"), F.col("one.text_key").alias("_key"), "times")
    rows = docs.select(F.struct(*kept).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))

    def rows_of(which: DataFrame) -> DataFrame:
        return rows.join(which, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")))

    single = rows_of(one.filter("times = 1")).select("_row.*")
    repeated = one.filter("times > 1")
    if repeated.isEmpty():
        return single
    return single.unionByName(rows_of(repeated).dropDuplicates(["_id", "_key"]).select("_row.*"))
