"""What the scoring of a batch of texts holds at a time."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pandas as pd

from carbonsplit.llm import toxicity


def test_tokens_are_held_as_numbers():
    """Each token was a string object of its own, and the messages of all texts of a batch were held at once."""
    choose = random.Random(3)
    vocabulary = [f"w{n}" for n in range(500)]
    texts = pd.Series(["\n".join(" ".join(choose.choices(vocabulary, k=25)) for _ in range(2000)) for _ in range(16)])
    weights = np.random.default_rng(3).normal(0, 0.1, toxicity.BUCKETS)
    model = toxicity.Crf(weights, -6.0, np.zeros((2, 2)), (-1.0, 0.5, 0.5))
    toxicity.scored(model, texts[:1])
    tracemalloc.start()
    found = toxicity.scored(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    alone = pd.concat([toxicity.scored(model, texts[i : i + 1]) for i in range(len(texts))], ignore_index=True)
    assert np.allclose(found["score"], alone["score"]) and list(found["spans"]) == list(alone["spans"])
    assert peak < 16 * texts.str.len().sum()


def test_documents_may_come_one_by_one():
    documents = [[["b", "a"], ["a"]], [], [["c", "a"]]]
    for given in (documents, iter(documents)):
        vocabulary, index, lengths, lines = toxicity._packed(given)
        assert (vocabulary, index.tolist(), lengths.tolist(), lines.tolist()) == (["b", "a", "c"], [0, 1, 1, 2, 1], [2, 1, 2], [2, 0, 1])
    assert [len(x) for x in toxicity._packed([])] == [0, 0, 0, 0]
