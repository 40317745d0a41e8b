"""How much of the lines is read, and which postings meet, on the way to their matches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from carbonsplit.llm import line_dedup
from carbonsplit.llm.common import settle


def _lines():
    """Lines of 1 to 90 words from a small vocabulary, many of them with near copies of other sizes."""
    choose = random.Random(3)
    vocabulary = [f"w{n}" for n in range(150)]
    lines = [choose.sample(vocabulary, choose.randint(1, 90)) for _ in range(120)]
    lines += [own + [f"new{n}{k}" for k in range(len(own) // 4)] for n, own in enumerate(lines[:60])]
    return lines + [own[: len(own) - len(own) // 5] for own in lines[60:120]]


def test_postings_of_unlike_sizes_do_not_meet(spark, monkeypatch):
    """All lines with a word met on it: pairs grew with the square of a word's lines, whatever their sizes."""
    lines = _lines()
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in enumerate(lines)], "doc_id long, text string")
    similarity = 80
    classes = settle(line_dedup.signatures(docs, similarity).dropDuplicates(["sig"]), "classes")
    number = {r.sig: r.doc_id for r in classes.collect()}
    none = settle(classes.select("sig").limit(0), "none")
    met = []
    by_size = line_dedup._by_size

    def counted(a, b, s):
        left, right = by_size(a, b, s)
        met.append((a.join(b, "word").count(), left.join(right, "key").count()))
        return left, right

    monkeypatch.setattr(line_dedup, "_by_size", counted)
    pairs = {(number[r.a], number[r.b]) for r in line_dedup.candidate_pairs(classes, none, similarity).collect()}
    sets = {n: set(lines[n]) for n in number.values()}
    true = {(a, b) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) * 100 >= len(sets[a] | sets[b]) * similarity}
    assert len(true) > 80 and true <= pairs
    assert sum(after for _, after in met) < 0.4 * sum(before for before, _ in met)


def test_few_near_copies_need_no_search_for_centers(spark, monkeypatch):
    """Every class that one other was matched with was searched for among all classes, before the join that finds all."""
    docs = spark.createDataFrame([(n, f"a{n // 3} b{n // 3} c{n // 3} d{n // 3} e{n // 3} f g h i j{n}") for n in range(60)], "doc_id long, text string")
    searched = []
    candidates = line_dedup.candidate_pairs
    monkeypatch.setattr(line_dedup, "candidate_pairs", lambda *given: searched.append(len(given) > 3) or candidates(*given))
    removed = sorted(r.doc_id for r in line_dedup.later_matches(docs).collect())
    assert removed == [n for n in range(60) if n % 3] and searched == [False]
    many = spark.createDataFrame([(n, f"a b c d e f g h i j{n}") for n in range(60)], "doc_id long, text string")
    assert len(line_dedup.later_matches(many).collect()) == 59 and searched == [False, True, False]


def test_words_are_split_at_the_quarters(spark):
    """Each bitmap was made by a pass of its own over the words of a line, up to four for long ones."""
    docs = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(n))) for n in (1, 2, 60, 200)], "doc_id long, text string")
    words = settle(line_dedup.line_words(docs), "words")
    for row in words.collect():
        assert row.words == sorted(set(row.words)) and len(row.words) == row.doc_id
        assert row.ends == [sum(w < x for w in row.words) for x in (-(2**62), 0, 2**62)]
    plan = line_dedup.described(words, line_dedup._rarity(words), 80)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == plan.count("aggregate(slice(words") == line_dedup.WIDE


def test_rows_repeated_in_id_and_text_give_one_class(spark):
    """A class had its first line once by a shuffle of all lines that are repeated, with their words."""
    docs = spark.createDataFrame([(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "c b a\nx y z")], "doc_id long, text string")
    words = settle(line_dedup.line_words(docs).withColumn("row", F.monotonically_increasing_id()), "words")
    first = line_dedup.first_lines(words, line_dedup.repeated_classes(words))
    assert sorted((r.doc_id, r.line_no) for r in first.collect()) == [(1, 0), (1, 1), (2, 1)]
    assert "Aggregate" not in first._jdf.queryExecution().optimizedPlan().toString()
    cut = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect())
    assert cut == [(1, "a b c\nd e f"), (1, "a b c\nd e f"), (2, "x y z")]
