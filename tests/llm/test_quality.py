"""Hashed n-grams and scores against plain Python."""

from __future__ import annotations

import collections
import math

import numpy as np
import pytest

from carbonsplit.llm import quality

MASK = (1 << 64) - 1
TEXTS = [None, "", " \n", "a", "ab  abc\tabcd abcde abcdef", "Été \U0001f600\U0001f600 x", "one two three two one", "z" * 3000, "one two three two one"]


def bucket(run, kind):
    value = sum((ord(c) + 1) * pow(quality._BASE, i, 1 << 64) for i, c in enumerate(run)) & MASK
    return value, mixed(value, kind)


def mixed(value, kind):
    x = (value + kind) * int(quality._MIX) & MASK
    x ^= x >> 32
    return (x * int(quality._MIX) & MASK) >> (64 - 17)


def by_hand(text):
    words = (text or "").split()
    found = collections.Counter()
    hashes = []
    for word in words:
        marked = f" {word} "
        found.update(bucket(marked[i : i + n], n)[1] for n in (3, 4, 5) for i in range(len(marked) - n + 1))
        value, own = bucket(word, 1)
        hashes.append(value)
        found[own] += 1
    found.update(mixed((a * quality._BASE + b) & MASK, 2) for a, b in zip(hashes, hashes[1:], strict=False))
    return found


@pytest.mark.parametrize("piece", [1, 40, 1 << 19])
def test_occurrences_and_scores(monkeypatch, piece):
    monkeypatch.setattr(quality, "PIECE", piece)
    want = [by_hand(t) for t in TEXTS]
    assert [dict(zip(b.tolist(), n.astype(int).tolist(), strict=True)) for b, n in quality.counted(TEXTS)] == [dict(w) for w in want]
    model = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype(np.float32)
    scores = [1 / (1 + math.exp(-(sum(float(model[b]) * n for b, n in w.items()) / max(1, sum(w.values())) + float(model[-1])))) for w in want]
    got = quality.score(TEXTS, model)
    assert got == pytest.approx(scores, rel=1e-9)
    assert got[6] == got[8] and got[0] == got[1] == got[2]
    assert len(quality.score([], model)) == 0
