"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carbonsplit.llm.common import cut

#: Bytes of benchmark text that one automaton takes (some 50 times that in memory); more items are scanned for in further passes.
BLOCK_BYTES = 4 << 20

_HIT = "array<struct<first: long, last: long, items: array<string>>>"
_HITS = f"n_words long, hits {_HIT}"
_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
#: ASCII other than 0-9, A-Z, a-z separates words; A-Z go to lower case; UTF-8 bytes above 127 stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def windows(item_words: list[bytes], size: int) -> set[bytes]:
    """All runs of ``size`` words; an item of fewer words is one window."""
    if not item_words:
        return set()
    return {b" ".join(item_words[i : i + size]) for i in range(max(1, len(item_words) - size + 1))}


def automaton(items: list[tuple[str, str | None]], size: int) -> ahocorasick.Automaton | None:
    """Finds every window, one separator on either side; each carries its word count and items."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item_id, text in items:
        for window in windows(words(text), size):
            owners[window].add(item_id)
    if not owners:
        return None
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, sorted(ids)))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton | None) -> tuple[int, list[dict]]:
    """Words of the text, and each occurrence of a window: first and last word (from 0) and items."""
    own = words(text)
    if not own or machine is None:
        return len(own), []
    ends, hits = None, []
    for at, (length, ids) in machine.iter(f" {b' '.join(own).decode('latin-1')} "):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        last = int(np.searchsorted(ends, at))
        hits.append({"first": last - length + 1, "last": last, "items": ids})
    return len(own), hits


def merged(n_words: int, hits: list[dict] | None) -> tuple[int, list[str], list[tuple[int, int]]]:
    """Hit words, items, and the runs of hit words as (first, last)."""
    runs: list[list[int]] = []
    items: set[str] = set()
    for hit in sorted(hits if hits is not None else [], key=lambda h: h["first"]):
        items.update(hit["items"])
        if runs and hit["first"] <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], hit["last"])
        else:
            runs.append([hit["first"], hit["last"]])
    return sum(b - a + 1 for a, b in runs), sorted(items), [(a, b) for a, b in runs]


def located(text: str | None, n_words: int, hits: list[dict]) -> tuple:
    """``n_words, n_hit, items, spans``: hit runs as code point offsets in the original text."""
    n_hit, items, runs = merged(n_words, hits)
    at = [m.span() for m in _WORD.finditer(text)] if runs else []
    return n_words, n_hit, items, [{"start": at[a][0], "end": at[b][1]} for a, b in runs]


def _scanner(items: list[tuple[str, str | None]], size: int, last: bool) -> Callable:
    """Adds this block's hits to those of earlier blocks; the last pass turns them into the result."""
    made: list = []  # built once per Python worker

    @F.pandas_udf(_FOUND if last else _HITS)
    def scanner(texts: pd.Series, earlier: pd.Series) -> pd.DataFrame:
        if not made:
            made.append(automaton(items, size))
        rows = []
        for text, before in zip(texts, earlier, strict=True):
            n, hits = scan(text, made[0])
            hits = [*before, *hits]
            rows.append(located(text, n, hits) if last else (n, hits))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"] if last else ["n_words", "hits"])

    return scanner


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in as many groups as their bytes need, read one group at a time, so that each automaton has a bounded size."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // block_bytes) + 1
    if n == 1:
        yield [(r.id, r.text) for r in items.collect()]
        return
    numbered = cut(items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n))), "benchmark")
    for i in range(n):
        yield [(r.id, r.text) for r in numbered.filter(F.col("block") == i).collect()]


def contaminated_words(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_words``, ``n_hit``, ``items`` and ``spans`` of hit text, one row per document.

    Words are lower-cased runs of digits, letters and non-ASCII.  A window is ``size``
    consecutive words of an item, or a whole shorter item; a document word inside an
    occurrence of a window is hit.  ``items`` are ids as strings, each once, in string
    order (a null id is the empty string); ``spans`` are code point offsets of the runs
    of hit words in the original text, end exclusive.  Null or empty text has no words;
    items without words match nothing; equal ids count as one item; repeated rows are
    scanned alike; empty tables give no rows or no hits; other columns do not matter.

    The text is scanned once by an automaton over all items.  The items are read on the
    driver in blocks of at most about ``block_bytes`` each; only a benchmark beyond that
    takes another pass per block, each from a written table.
    """
    rows = docs.select(F.struct(*keep).alias("_keep"), "text", F.array().cast(_HIT).alias("hits"))
    groups = blocks(benchmark, block_bytes)
    group = next(groups)
    for following in groups:
        found = rows.withColumn("_s", _scanner(group, size, last=False)("text", "hits"))
        rows = cut(found.select("_keep", "text", F.col("_s.hits").alias("hits")), "scanned")
        group = following
    return rows.withColumn("_s", _scanner(group, size, last=True)("text", "hits")).select("_keep.*", "_s.*")
