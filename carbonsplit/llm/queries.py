"""The registered queries: each applies one operator to its whole table.

Operators keep their own results; the digest columns are derived here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carbonsplit.llm import chat, conversations, decontamination, html_text, labelled, line_dedup, mixing, quality, resampling, secrets, simhash, topk, toxicity, vantage
from carbonsplit.llm.common import read_table


def sha256_of(parts: Column) -> Column:
    """Lowercase hex digest of strings joined by commas."""
    return F.sha2(F.concat_ws(",", parts), 256)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_words(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        sha256_of(F.col("items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).drop("label")


def _judged(found: DataFrame, held_out: Column) -> DataFrame:
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), labelled.held_out(3, 1))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), labelled.held_out(4, 2))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))))

    return found.select(
        "doc_id", *[count(rule.kind) for rule in secrets.BASE_RULES], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_conversations(rows)).withColumn("conv_id", F.col("conv_id").cast("long"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of ``conv_id:turn``; every null is read as one space."""
    read = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.pmod(F.crc32(F.concat(read[0], F.lit(":"), read[1])), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(read[3], "[.!?]", "")).otherwise(read[3])
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(read[2]).alias("role"), text.alias("text"), times.alias("times"))
    return out.withColumn("time", F.explode(F.array_repeat(F.lit(1), F.col("times")))).drop("times", "time")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations")
    turns, summary = conversations.repair(damaged(rows))
    # every id, its counts and its digest meet in one grouped pass; null is a conversation's id as well
    found = rows.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("conv_id").cast("long").alias("id"))
    for part in (summary, conversations.text_digests(turns)):
        found = found.unionByName(part, allowMissingColumns=True)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    counts = [F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in names]
    digest = F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    one = found.groupBy("conv_id").agg(F.max("id").alias("id"), *counts, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), digest)
    return one.select(F.col("id").alias("conv_id"), *names, "audit", "repaired_sha256")


def op13_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_html_extraction,
        op3_topk_search,
        op4_benchmark_decontamination,
        op5_simhash_near_dedup,
        op6_toxicity,
        op7_quality_classifier,
        op8_secret_scan,
        op9_chat_formatting,
        op10_source_mixing,
        op11_importance_resampling,
        op12_conversation_repair,
        op13_vantage_neighbours,
    )
}
