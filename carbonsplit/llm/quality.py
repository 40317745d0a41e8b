"""Quality classifier: learned vectors of hashed word and character n-grams, averaged per document.

Every word, word pair and run of 3 to 5 characters of a word has a vector in a hashed
table; a document is the mean of its vectors; a softmax layer gives the classes.  Table
and layer are learned together by stochastic gradient descent in numpy on a bounded
sample of labelled texts.  Scoring needs only each vector's product with the layer, so
workers get one number per bucket.

The hash of a run is a polynomial in its code points, taken from running sums over a
whole batch, so no word or run is looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonsplit.llm.labelled import training_rows

_BUCKET_BITS = 17
BUCKETS = 1 << _BUCKET_BITS
WIDTH = 8
_GRAMS = (3, 4, 5)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Code points that are hashed at a time; a longer text is taken alone.
PIECE = 1 << 19


def pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in runs of about ``PIECE`` code points, each with one space around every word."""
    own, size = [], 0
    for text in texts:
        spaced = f" {' '.join((text or '').split())} "
        if own and size + len(spaced) > PIECE:
            yield own
            own, size = [], 0
        own.append(spaced)
        size += len(spaced)
    if own:
        yield own


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind)) * _MIX
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * _MIX) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base squared and so on, modulo 2**64."""
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


def occurrences(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``place, bucket`` of all runs of each size, all words and all word pairs; places ascend.

    A space marks the beginning and the end of a word, and no run goes on beyond it.
    """
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    powers, back = _powers(_BASE, len(codes)), _powers(_INVERSE, len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * powers, dtype=np.uint64)])
    space = codes == 32
    for n in _GRAMS:
        inside = np.zeros(max(0, len(codes) - n + 1), bool)
        for i in range(1, n - 1):
            inside |= space[i : i + len(inside)]
        at = np.flatnonzero(~inside)
        yield at, _bucket((sums[at + n] - sums[at]) * back[at], n)
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words = (sums[ends] - sums[starts]) * back[starts]
    yield starts, _bucket(words, 1)
    # texts lie two spaces apart, words of a text one
    pair = np.flatnonzero(starts[1:] == ends[:-1] + 1)
    yield starts[pair], _bucket(words[pair] * np.uint64(_BASE) + words[pair + 1], 2)


def edges(texts: list[str]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def counted(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each whole text and how often each occurs."""
    out = []
    for part in pieces(texts):
        at, buckets = (np.concatenate(x) for x in zip(*occurrences(part), strict=True))
        owner = np.searchsorted(edges(part), at, side="right") - 1
        order = np.argsort(owner, kind="stable")
        for own in np.split(buckets[order], np.searchsorted(owner[order], np.arange(1, len(part)))):
            found, counts = np.unique(own, return_counts=True)
            out.append((found, counts.astype(np.float32)))
    return out


def train(rows: list[tuple[str, int]], epochs: int = 6, batch: int = 32, rate: float = 0.5, seed: int = 7) -> np.ndarray:
    """Log-odds that each bucket adds to a document's mean, and the bias last."""
    labels = np.array([label for _, label in rows])
    result = np.zeros(BUCKETS + 1, np.float32)
    if len(set(labels.tolist())) < 2:
        return result
    documents = counted([text for text, _ in rows])
    random = np.random.default_rng(seed)
    table = random.normal(0, 0.1, (BUCKETS, WIDTH))
    layer = random.normal(0, 0.1, (WIDTH, 2))
    bias = np.log(np.bincount(labels, minlength=2) / len(labels))
    table_squares, layer_squares = np.full(BUCKETS, 1e-8), np.full((WIDTH, 2), 1e-8)
    for _ in range(epochs):
        shuffled = random.permutation(len(rows))
        for start in range(0, len(rows), batch):
            chosen = shuffled[start : start + batch]
            buckets = np.concatenate([documents[i][0] for i in chosen])
            shares = np.concatenate([documents[i][1] / max(1, documents[i][1].sum()) for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(documents[i][0]) for i in chosen])
            mean = np.zeros((len(chosen), WIDTH))
            np.add.at(mean, owner, table[buckets] * shares[:, None])
            scores = mean @ layer + bias
            scores -= scores.max(axis=1, keepdims=True)
            chance = np.exp(scores)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(chosen)), labels[chosen]] -= 1
            chance /= len(chosen)
            by_layer = mean.T @ chance
            by_mean = chance @ layer.T
            layer_squares += by_layer**2
            layer -= rate * by_layer / np.sqrt(layer_squares)
            bias = bias - 0.05 * rate * chance.sum(axis=0)
            used, inverse = np.unique(buckets, return_inverse=True)
            step = np.zeros((len(used), WIDTH))
            np.add.at(step, inverse, by_mean[owner] * shares[:, None])
            table_squares[used] += (step**2).sum(axis=1) / WIDTH
            table[used] -= 0.1 * rate * step / np.sqrt(table_squares[used])[:, None]
    result[:-1] = table @ (layer[:, 1] - layer[:, 0])
    result[-1] = bias[1] - bias[0]
    return result


def score(texts: Iterable[str | None], model: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text; a text without words has the bias alone."""
    out = []
    for part in pieces(texts):
        ends = edges(part)
        total, n = np.zeros(len(part)), np.zeros(len(part), np.int64)
        for at, buckets in occurrences(part):
            first = np.searchsorted(at, ends)
            sizes = np.diff(first)
            some = np.flatnonzero(sizes)
            if len(some):
                # each text's run is summed on its own, so equal texts score alike
                total[some] += np.add.reduceat(model[buckets].astype(np.float64), first[some])
            n += sizes
        out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(1, n) + float(model[-1]), -40, 40))))
    return np.concatenate(out) if out else np.zeros(0)


def quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), max_good: int = 1000, max_poor: int = 600) -> DataFrame:
    """``keep`` columns and ``score`` (0 to 1, higher: label 1 likelier), one row per document.

    Learned from at most ``max_good`` and ``max_poor`` labelled documents, never from
    those whose crc32 of the id, modulo 4, is 2.  Whole texts are scored; only the text
    is an input.  Null and empty texts have no vectors and get the bias; repeated rows
    score alike; without labels of both kinds every score is one half; empty tables give
    no rows; other columns do not matter.
    """
    model = train(training_rows(docs, labels, "quality", 4, 2, {1: max_good, 0: max_poor}))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(texts, shared.value), dtype="float64")

    return docs.select(F.struct(*keep).alias("_keep"), scored("text").alias("score")).select("_keep.*", "score")
