"""N-gram interning and importance resampling against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from carbonsplit.llm import ngram_table, resampling
from carbonsplit.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def by_hand(docs, items, percent=5):
    """Rows of ``(doc_id, text)`` as ``(doc_id, n_features, weight, score, rank)``."""
    found = [(i, *features(t)) for i, t in docs]
    s, t = collections.Counter(bucket(f) for *_, fs in found for f in fs), collections.Counter(bucket(f) for x in items for f in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000.0) / ((s[b] + 1.0) * (all_t + 10_000.0)))) for b in range(10_000)]
    rows = []
    for i, n, fs in found:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    take = len(able) * percent // 100
    drawn = [(i, n, w, x, k) for k, (i, _, n, w, x) in enumerate(able[:take], 1)]
    return drawn + [(i, n, w, x, None) for i, _, n, w, x in able[take:] + [r for r in rows if r[1] < 20]]


def plain(rows):
    return sorted((tuple(r) for r in rows), key=str)


ODD = [None, "", " .,", "a", "ab " * 3, "x" * 500 + " y z " + "Q" * 97 + " ärger " + "q" * 97 + " " + "x" * 500, "Über-Straße 12,5 \x00 I'm", "w" * 70_000 + " end", "\U0001f600 é A-Z"]


@pytest.mark.parametrize("words", [1, 7, 1 << 16])
def test_all_occurrences_have_the_slot_of_their_bytes(monkeypatch, words):
    monkeypatch.setattr(ngram_table, "WORDS", words)
    texts = [*ODD, "to be or not to be that is to be", *ODD]
    counts, buckets = collections.Counter(), collections.Counter()
    for at, part in ngram_table.pieces(pa.array(texts), 200):
        for found in ngram_table.ngrams(part, 3):
            assert found.table.count.sum() == len(found.table.slot) == len(found.text)
            counts.update(at + n for n in found.text.tolist())
            buckets.update((found.crc[found.table.slot] % 10_000).tolist())
    want = [features(t)[1] for t in texts]
    assert counts == collections.Counter({i: len(f) for i, f in enumerate(want) if f})
    assert buckets == collections.Counter(bucket(f) for fs in want for f in fs)


def test_keys_are_xxhash64():
    data = np.frombuffer(bytes(range(256)) + bytes(8), np.uint8)
    lengths = np.arange(1, 130)
    got = ngram_table.hashes(data, np.full(len(lengths), 3), lengths)
    assert [int(k) for k in got] == [xxhash.xxh64_intdigest(bytes(range(256))[3 : 3 + n]) for n in lengths]


def test_equal_keys_are_told_apart_by_their_bytes():
    words = ngram_table.cut_words(pa.array(["one two one six two one " + "l" * 200 + " " + "l" * 199 + "m"]))
    table = ngram_table.intern(words.bytes, words.starts, words.lengths, keys=np.zeros(len(words.starts), np.uint64))
    by_slot = collections.defaultdict(set)
    for slot, a, n in zip(table.slot.tolist(), words.starts.tolist(), words.lengths.tolist(), strict=True):
        by_slot[slot].add(words.bytes[a : a + n].tobytes())
    assert len(by_slot) == 5 and all(len(x) == 1 for x in by_slot.values())


def test_odd_texts(spark):
    choose = random.Random(5)
    words = ["red", "blue", "Green", "été", "4"]
    docs = list(enumerate(ODD)) + [(100 + n, " ".join(choose.choices(words, k=choose.randint(15, 60)))) for n in range(60)]
    docs += [(100, docs[-1][1]), (100, docs[-1][1]), (None, docs[-2][1])]
    items = ["red red blue été", None, "", "4 4 green"]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, weight int, bucket int, _row string")
    target = spark.createDataFrame([(n, t) for n, t in enumerate(items)], "item_id long, text string")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    got = resampling.resample(frame.repartition(5), target, percent=40).select(columns).collect()
    assert plain(got) == plain(by_hand(docs, items, 40))
    kept = resampling.drawn_documents(frame, target, percent=40)
    assert kept.columns == frame.columns and kept.count() == sum(r.rank is not None for r in got)
    assert resampling.resample(frame.limit(0), target).collect() == []
    assert plain(resampling.resample(frame, target.limit(0)).select(columns).collect()) == plain(by_hand(docs, []))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_registered_query(spark):
    texts = {t: [(r[0], r.text) for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").collect()] for t in ("documents", "benchmark")}
    want = by_hand(texts["documents"], [t for _, t in texts["benchmark"]])
    assert plain(QUERIES["op11_importance_resampling"](spark, FOLDER).collect()) == plain(want)
