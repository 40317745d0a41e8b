"""What is kept of a line for the comparison."""

from __future__ import annotations

import random

from carbonsplit.llm import line_dedup


def test_words_are_numbered_and_sorted_once(spark):
    """Words were sorted by hash and by rarity, the second time as objects, and each line had four bitmaps."""
    choose = random.Random(7)
    words = [f"w{n}" for n in range(400)]
    lines = [choose.sample(words, n) for n in (5, 47, 48, 159, 160, 300)]
    lines.append(lines[5][:-9] + ["Ä\tö", "\x0b", "x"])
    docs = spark.createDataFrame([(n, " ".join(line)) for n, line in enumerate(lines)], "doc_id long, text string")
    found = line_dedup.signatures(docs, 80)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("sort_array(") == 1
    rows = {r.doc_id: r for r in found.collect()}
    sets = [set(" ".join(line).lower().split()) for line in lines]
    assert [rows[n].n for n in range(len(lines))] == [len(s) for s in sets]
    assert [n for n in rows if rows[n].half is None] == [0, 1] and sorted(n for n in rows if rows[n].wide) == [4, 5, 6]
    for n in (4, 5, 6):
        neither, one, other, both = rows[n].wide
        assert rows[n].bits == neither ^ one ^ other ^ both and rows[n].half == one ^ both
    apart = sum((a ^ b).bit_count() if (a ^ b) >= 0 else ((a ^ b) + 2**64).bit_count() for a, b in zip(rows[5].wide, rows[6].wide, strict=True))
    assert 0 < apart <= len(sets[5] ^ sets[6])
    prefix = [rows[n].prefix for n in range(len(lines))]
    assert all(p == sorted(p) and len(p) == len(s) - -(-len(s) * 80 // 100) + 1 for p, s in zip(prefix, sets, strict=True))
    assert set(prefix[5]) & set(prefix[6])


def test_texts_are_cut_into_words_once(spark, monkeypatch):
    """Texts were cut into words for the rarity of words and again for the lines."""
    docs = spark.createDataFrame([(1, "a b c\nd e"), (2, "c b a")], "doc_id long, text string")
    seen = []
    cut = line_dedup._words
    monkeypatch.setattr(line_dedup, "_words", lambda line: seen.append(line) or cut(line))
    words = line_dedup.settle(line_dedup.line_words(docs), "words")
    rows = {(r.doc_id, r.line_no): r for r in words.collect()}
    assert rows[1, 0].words == rows[2, 0].words and rows[1, 0].sig == rows[2, 0].sig != rows[1, 1].sig
    plan = line_dedup.described(words, line_dedup._rarity(words), 80)._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "text#" not in plan
