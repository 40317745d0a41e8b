"""Which pairs of lines are compared at all."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from carbonsplit.llm import line_dedup
from carbonsplit.llm.common import settle


def test_long_unlike_lines_are_refused_in_the_join(spark):
    """Of long lines a bitmap of 64 bits lets many unlike pairs through: their number grew with the square of the lines."""
    choose = random.Random(5)
    vocabulary = [f"w{n}" for n in range(1500)]
    lines = [choose.sample(vocabulary, choose.randint(130, 170)) for _ in range(300)]
    lines += [own[:-4] + ["new1", "new2"] for own in lines[:10]]
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in enumerate(lines)], "doc_id long, text string")
    classes = settle(line_dedup.signatures(docs, 80), "lines")
    number = {r.sig: r.doc_id for r in classes.select("sig", "doc_id").collect()}
    none = settle(classes.select("sig").limit(0), "none")
    pairs = {(number[r.a], number[r.b]) for r in line_dedup.candidate_pairs(classes, none, 80).collect()}

    def alike(a, b):
        one, other = set(lines[a]), set(lines[b])
        return len(one & other) / len(one | other) >= 0.8

    true = {(a, b) for a in range(len(lines)) for b in range(a) if alike(a, b)}
    assert len(true) == 10 and true <= pairs
    assert len(pairs) <= 4 * len(true)


def test_pairs_of_short_and_long_lines_are_kept(spark):
    """A line just short of a wide bitmap and one just long enough for it."""
    words = [f"w{n}" for n in range(line_dedup.WIDE_FROM + 3)]
    docs = spark.createDataFrame([(1, " ".join(words[:-4])), (2, " ".join(words)), (3, " ".join(words[4:]))], "doc_id long, text string")
    assert line_dedup.WIDE_FROM - 1 in [r.n for r in line_dedup.signatures(docs, 80).select(F.col("n")).collect()]
    removed = {r.doc_id for r in line_dedup.later_matches(docs).collect()}
    assert removed == {2, 3}


def test_centers_beyond_a_broadcast_are_joined_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(n, f"a b c d e f g h i j{n}") for n in range(12)] + [(50, "k l m n o")], "doc_id long, text string")
    whole = sorted(r.doc_id for r in line_dedup.later_matches(docs).collect())
    monkeypatch.setattr("carbonsplit.llm.common.BROADCAST_ROWS", 1)
    monkeypatch.setattr(line_dedup, "PAIRS_PER_ROUND", 3)
    assert whole == list(range(1, 12)) == sorted(r.doc_id for r in line_dedup.later_matches(docs).collect())


def test_shorter_sets_are_looked_up_by_fewer_words(spark, monkeypatch):
    """Both sides of the join had the whole prefix, the frequent words at its end included."""
    choose = random.Random(11)
    vocabulary = [f"w{n}" for n in range(60)]
    lines = [choose.sample(vocabulary, choose.randint(18, 24)) for _ in range(60)]
    lines += [own + [f"new{k}" for k in range(n % 4)] for n, own in enumerate(lines[:40])] + [own[: -1 - n % 4] for n, own in enumerate(lines[20:])]
    docs = spark.createDataFrame([(n // 2, " ".join(words)) for n, words in enumerate(lines)], "doc_id long, text string")
    classes = settle(line_dedup.signatures(docs, 80), "lines")
    none = settle(classes.select("sig").limit(0), "none")
    sides = []
    met = line_dedup._met_shorter
    monkeypatch.setattr(line_dedup, "_met_shorter", lambda a, b, s: sides.append((a.count(), b.count())) or met(a, b, s))
    pairs = {(r.a, r.b) for r in line_dedup.candidate_pairs(classes, none, 80).collect()}
    assert sum(b for _, b in sides) < 0.75 * sum(a for a, _ in sides)
    place = {(r.doc_id, r.text_key, r.line_no): r.sig for r in classes.collect()}
    sets = {sig: set(lines_of) for sig, lines_of in zip([place[r.doc_id, r.text_key, 0] for r in docs.select(*line_dedup._document_key()).collect()], lines, strict=True)}
    first = {r.sig: r.doc_id for r in classes.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).collect()}
    alike = {(a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and first[a] > first[b]}
    assert len(alike) > 40 and alike <= pairs
