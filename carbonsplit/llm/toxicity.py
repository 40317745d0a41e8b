"""Toxic spans by a linear-chain conditional random field.

The labels mark whole documents.  Tokens are labelled from them first: a word, or one
of its beginnings, that is common in toxic training documents and all but absent from
the others marks its tokens there.  A two-state chain over the tokens of each line is
then fitted to those tags by gradient ascent on the exact log-likelihood; forward and
backward messages give each token's marginal.  A document's score is a logistic
function of its marginals, fitted on the same training documents.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut, small
from carbonsplit.llm.labelled import training_rows, usable_labels

#: A token: a run of letters, digits and marks; other characters only separate.
_TOKEN = re.compile(r"\w+")
#: Hash buckets of the feature weights.
BUCKETS = 1 << 18
_PREFIXES = (3, 4, 5, 6)
_SPAN = "array<struct<start: long, end: long>>"
SPAN_MARGINAL = 0.5


@dataclass
class Crf:
    """``weights`` of the toxic state's features, ``bias``, transition scores ``[from, to]``, and the document's logistic."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    scale: tuple[float, float, float] = (0.0, 1.0, 0.0)


def features(word: str) -> list[int]:
    """Buckets of the word, its beginnings and its ending."""
    named = [f"w={word}", f"s={word[-3:]}", *(f"p{n}={word[:n]}" for n in _PREFIXES if len(word) >= n)]
    return [xxhash.xxh64_intdigest(x) % BUCKETS for x in named]


def stems(word: str) -> list[str]:
    return [f"w={word}", *(f"p={word[:n]}" for n in _PREFIXES if len(word) >= n)]


def lines_of(text: str | None) -> list[list[str]]:
    """Lower-cased tokens, a chain per line; lines without tokens are left out."""
    found = (_TOKEN.findall(line) for line in (text or "").lower().split("\n"))
    return [tokens for tokens in found if tokens]


def toxic_stems(docs: DataFrame, labels: DataFrame, least: int = 4, share: float = 0.01, odds: float = 25.0) -> set[str]:
    """Words and beginnings that mark toxic tokens, counted over all labelled documents that may be learned from.

    A mark is found in at least ``least`` (and ``share``) as many places as there are toxic
    documents, and ``odds`` times as often there as in the others.  Words are counted by
    document and label first, so only the vocabulary is shuffled; what comes to the
    driver are the marks.
    """
    # ids and integers only: broadcast up to a checked size, so that texts stay where they are read
    known = small(cut(usable_labels(labels, "toxic", 3, 1), "toxic-labels"))
    texts = docs.join(known, docs["doc_id"] == F.col("_id")).select("_label", F.coalesce("text", F.lit("")).alias("text"))
    sizes = {r["_label"]: r["count"] for r in docs.select("doc_id").join(known, F.col("doc_id") == F.col("_id")).groupBy("_label").agg(F.countDistinct("_id").alias("count")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    words = texts.select("_label", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), 1))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("_label").alias("toxic"), F.sum(1 - F.col("_label")).alias("other"))
    word = F.col("word")
    beginnings = [F.when(F.length(word) >= n, F.concat(F.lit("p="), F.substring(word, 1, n))) for n in _PREFIXES]
    named = counts.select("toxic", "other", F.explode(F.array_compact(F.array(F.concat(F.lit("w="), word), *beginnings))).alias("stem"))
    sums = named.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    marks = sums.filter((F.col("toxic") >= max(least, share * toxic)) & (F.col("toxic") / max(1, toxic) >= odds * (F.col("other") + 0.5) / max(1, other)))
    return {r.stem for r in marks.select("stem").collect()}


def pieces(lines: list[list[str]], length: int = 200) -> list[list[str]]:
    """Chains of at most ``length`` tokens: training works on these, scoring on whole lines."""
    return [line[i : i + length] for line in lines for i in range(0, len(line), length)]


class Chains:
    """Token sequences packed for message passing: all chains advance one token at a time."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        self.starts, self.lengths = starts[self.order], lengths[self.order]
        self.steps = int(lengths.max(initial=0))
        # chains still running at each step
        self.active = np.searchsorted(-self.lengths, -np.arange(self.steps), side="left")

    def messages(self, emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of the toxic state from the left (its own emission included) and from the right."""
        e = np.exp(moves)
        left, right = np.empty_like(emit), np.zeros_like(emit)
        for t in range(self.steps):
            at = self.starts[: self.active[t]] + t
            if t:
                p = _sigmoid(left[at - 1])
                left[at] = emit[at] + np.log((p * e[1, 1] + (1 - p) * e[0, 1]) / (p * e[1, 0] + (1 - p) * e[0, 0]))
            else:
                left[at] = emit[at]
        for t in range(self.steps - 2, -1, -1):
            at = self.starts[: self.active[t + 1]] + t
            p = _sigmoid(emit[at + 1] + right[at + 1])
            right[at] = np.log((p * e[1, 1] + (1 - p) * e[1, 0]) / (p * e[0, 1] + (1 - p) * e[0, 0]))
        return left, right

    def pairs(self, emit: np.ndarray, moves: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Expected transitions ``[from, to]`` over all chains."""
        follows = np.ones(len(emit), bool)
        follows[self.starts] = False
        at = np.nonzero(follows)[0]
        if not len(at):
            return np.zeros((2, 2))
        p, q = _sigmoid(left[at - 1]), _sigmoid(emit[at] + right[at])
        joint = np.exp(moves)[:, :, None] * np.stack([np.stack([(1 - p) * (1 - q), (1 - p) * q]), np.stack([p * (1 - q), p * q])])
        return (joint / joint.sum(axis=(0, 1))).sum(axis=2)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _packed(documents: Iterable[list[list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, word index per token, tokens per line, lines per document.

    The documents may come one by one: a token is kept as its number, and as a string only once.
    """
    numbers: dict[str, int] = {}
    index, lengths, lines = array("q"), array("q"), array("q")
    for document in documents:
        lines.append(len(document))
        for line in document:
            lengths.append(len(line))
            index.extend([numbers.setdefault(w, len(numbers)) for w in line])
    return list(numbers), *(np.array(x, np.int64) for x in (index, lengths, lines))


def _feature_table(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after another, and the word of each."""
    each = [features(w) for w in vocabulary]
    return np.array([f for fs in each for f in fs], np.int64), np.repeat(np.arange(len(each)), [len(fs) for fs in each])


def marginals(model: Crf, documents: Iterable[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """The toxic state's log-odds per token of all documents, and the tokens per document."""
    vocabulary, index, lengths, lines = _packed(documents)
    owner = np.repeat(np.arange(len(lines)), lines)
    per_document = np.bincount(owner, weights=lengths, minlength=len(lines)).astype(np.int64)
    if not len(index):
        return np.zeros(0), per_document
    buckets, word = _feature_table(vocabulary)
    emit = (np.bincount(word, weights=model.weights[buckets], minlength=len(vocabulary)) + model.bias)[index]
    left, right = Chains(lengths).messages(emit, model.moves)
    return left + right, per_document


def fit_tags(documents: list[list[list[str]]], marks: set[str], toxic: list[int], rounds: int, rate: float = 0.3, decay: float = 1e-5) -> Crf:
    """Maximum likelihood of the token tags by full-batch Adagrad."""
    vocabulary, index, lengths, lines = _packed(documents)
    model = Crf(np.zeros(BUCKETS), -3.0, np.zeros((2, 2)))
    if not len(index):
        return model
    marked = np.array([any(s in marks for s in stems(w)) for w in vocabulary])
    owner = np.repeat(np.repeat(np.array(toxic), lines), lengths)
    tags = marked[index] & (owner == 1)
    buckets, word = _feature_table(vocabulary)
    chains = Chains(lengths)
    follows = np.ones(len(index), bool)
    follows[chains.starts] = False
    at = np.nonzero(follows)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (tags[at - 1].astype(int), tags[at].astype(int)), 1)
    squares, bias_square, move_square = np.full(BUCKETS, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    n = max(1.0, tags.sum())
    for _ in range(rounds):
        emit = (np.bincount(word, weights=model.weights[buckets], minlength=len(vocabulary)) + model.bias)[index]
        left, right = chains.messages(emit, model.moves)
        miss = tags - _sigmoid(left + right)
        by_word = np.bincount(index, weights=miss, minlength=len(vocabulary))
        step = np.bincount(buckets, weights=by_word[word], minlength=BUCKETS) / n - decay * model.weights
        squares += step**2
        model.weights += rate * step / np.sqrt(squares)
        by_bias = miss.sum() / n
        bias_square += by_bias**2
        model.bias += rate * by_bias / np.sqrt(bias_square)
        by_move = (seen - chains.pairs(emit, model.moves, left, right)) / n
        move_square += by_move**2
        model.moves = model.moves + 0.3 * rate * by_move / np.sqrt(move_square)
    return model


def evidence(log_odds: np.ndarray, per_document: np.ndarray) -> np.ndarray:
    """Two numbers per document: the clearest token's log-odds and the log of the expected toxic tokens."""
    owner = np.repeat(np.arange(len(per_document)), per_document)
    clearest = np.full(len(per_document), -12.0)
    np.maximum.at(clearest, owner, np.clip(log_odds, -12, 12))
    expected = np.bincount(owner, weights=_sigmoid(log_odds), minlength=len(per_document))
    return np.stack([clearest, np.log(expected + 1e-4)], axis=1)


def fit_scale(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float, float]:
    """Logistic regression of the document label on the evidence, by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.array([0.0, 0.1, 0.0])
    penalty = ridge * np.diag([0.01, 1.0, 1.0])
    for _ in range(30):
        p = _sigmoid(a @ w)
        w = w + np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - penalty @ w)
    return tuple(float(v) for v in w)


def train(rows: list[tuple[str, int]], marks: set[str], rounds: int = 40) -> Crf:
    """A model from ``(text, label)``; without rows of both labels every score is one half or less."""
    # one string object for each different token
    documents = [[[sys.intern(w) for w in line] for line in lines_of(text)] for text, _ in rows]
    labels = [label for _, label in rows]
    if len(set(labels)) < 2:
        return Crf(np.zeros(BUCKETS), -3.0, np.zeros((2, 2)), (-1.0 if 1 not in labels else 0.0, 0.0, 0.0))
    model = fit_tags([pieces(lines) for lines in documents], marks, labels, rounds)
    model.scale = fit_scale(evidence(*marginals(model, documents)), np.array(labels))
    return model


def offsets(text: str, log_odds: np.ndarray) -> list[dict]:
    """Code point spans of the tokens whose marginal reaches ``SPAN_MARGINAL``.

    A token's place is looked up in the original text; lower-casing may change lengths,
    so each line's tokens are found there by number.
    """
    spans, at, start = [], 0, 0
    for line in text.split("\n"):
        own = list(_TOKEN.finditer(line))
        n = len(_TOKEN.findall(line.lower()))
        for k in np.nonzero(log_odds[at : at + n] >= np.log(SPAN_MARGINAL / (1 - SPAN_MARGINAL)))[0]:
            if k < len(own):
                spans.append({"start": start + own[k].start(), "end": start + own[k].end()})
        at += n
        start += len(line) + 1
    return spans


#: Code points whose messages are passed at a time (whole documents; a longer one goes alone).
_BATCH_CHARS = 2 << 20


def batches(texts: pd.Series):
    part, chars = [], 0
    for text in texts:
        if part and chars + len(text or "") > _BATCH_CHARS:
            yield part
            part, chars = [], 0
        part.append(text)
        chars += len(text or "")
    if part:
        yield part


def scored(model: Crf, texts: pd.Series) -> pd.DataFrame:
    """``score`` and ``spans`` of each text."""
    scores, spans = [], []
    bias, by_clearest, by_expected = model.scale
    for part in batches(texts):
        log_odds, per_document = marginals(model, (lines_of(t) for t in part))
        x = evidence(log_odds, per_document)
        scores.append(_sigmoid(bias + by_clearest * x[:, 0] + by_expected * x[:, 1]))
        ends = np.cumsum(per_document)
        spans += [offsets(t, log_odds[b - n : b]) if n and log_odds[b - n : b].max() >= 0 else [] for t, n, b in zip(part, per_document, ends, strict=True)]
    return pd.DataFrame({"score": np.concatenate(scores) if scores else np.zeros(0), "spans": spans})


def scorer(docs: DataFrame, model: Crf):
    """A function of a text column: ``struct<score, spans>``."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), float(model.bias), model.moves, model.scale))

    @F.pandas_udf(f"score double, spans {_SPAN}")
    def score(texts: pd.Series) -> pd.DataFrame:
        return scored(Crf(*shared.value), texts)

    return score


def fitted(docs: DataFrame, labels: DataFrame, max_toxic: int = 600, max_clean: int = 900) -> Crf:
    """The model learned from at most ``max_toxic`` and ``max_clean`` labelled documents, with marks counted over all.

    Documents whose crc32 of the id, modulo 3, is 1 are never learned from.
    """
    return train(training_rows(docs, labels, "toxic", 3, 1, {1: max_toxic, 0: max_clean}), toxic_stems(docs, labels))


def toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), **sample: int) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``spans`` of the offending tokens, one row per document.

    Whole texts are scored; only the text is an input of a score.  Null, empty and
    token-free texts get the score of a text without toxic tokens; repeated rows score
    alike; without usable labels of both kinds all texts score at most one half; empty
    tables give no rows; other columns do not matter.
    """
    score = scorer(docs, fitted(docs, labels, **sample))
    return docs.select(F.struct(*keep).alias("_keep"), score(F.col("text")).alias("_s")).select("_keep.*", "_s.*")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns unchanged."""
    score: Column = scorer(docs, fitted(docs, labels))(F.col("text"))
    return docs.filter(score.getField("score") < threshold)
