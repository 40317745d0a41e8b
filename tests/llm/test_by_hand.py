"""The registered SimHash and secret queries against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import pytest
import xxhash

from carbonsplit.llm.registry import QUERIES

FOLDER, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_of_real_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    value = {i: by_hand(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    for i, j in itertools.combinations(sorted(texts), 2):
        if (value[i] ^ value[j]).bit_count() <= 2:
            low, high = sorted((label[i], label[j]))
            label = {n: low if at == high else at for n, at in label.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash_near_dedup"](spark, FOLDER).collect()}
    assert got == {i: (f"{value[i]:016x}", label[i]) for i in texts}


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text):
    """``(kind, start, end)`` in the order of the digest."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def test_secrets_of_real_texts(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MORE}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op8_secret_scan"](spark, MORE).collect()}
    assert set(got) == set(texts) and any(r.n_assign + r.n_access + r.n_hex for r in got.values())
    for i, text in texts.items():
        want = base_secrets(text)
        counts = [sum(kind == k for k, *_ in want) for kind in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256] == [*counts, hashlib.sha256(joined.encode()).hexdigest()], i
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(got[i].spans.split(","))
