"""Interning of n-grams in an open-addressed NumPy table.

The texts of a batch become one byte buffer of lower-cased words, each after one space.
An n-gram is a span of that buffer; its key is the XXH64 of the bytes.  All n-grams of a
stretch of words enter a table at once: each round, the ones still without a slot look at
their place, empty places are claimed, equal bytes share a slot, and the rest move on by
one place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = 0x20
#: Bytes of texts that are cut into words at a time (a longer text is taken alone), and words that enter a table at a time.
BUFFER_BYTES = 1 << 21
WORDS = 1 << 16
#: Longer spans are hashed and compared one by one.
LONG = 96
#: Padding behind a buffer, so that eight bytes can be read at any place.
_PAD = 8

_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _word_bytes() -> np.ndarray:
    """Every byte in lower case if it belongs to words, else a space."""
    table = np.full(256, SPACE, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[low : high + 1] = np.arange(low, high + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_WORD_BYTES = _word_bytes()


class Words(NamedTuple):
    """The words of some texts: ``bytes`` (padded), and per word its start, length and text number."""

    bytes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    text: np.ndarray


def cut_words(texts: pa.Array) -> Words:
    data, offsets = _buffer(texts)
    mapped = np.empty(len(data) + 1, np.uint8)
    mapped[0] = SPACE
    _WORD_BYTES.take(data, out=mapped[1:])
    word = mapped != SPACE
    turns = np.flatnonzero(word[1:] != word[:-1])  # the buffer begins and ends with a separator
    starts, ends = turns[::2], turns[1::2]
    lengths = ends - starts
    word[starts] = True  # the separator before each word stays
    kept = np.concatenate([mapped[word], np.full(_PAD, SPACE, np.uint8)])
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(kept, 1 + np.cumsum(lengths + 1) - (lengths + 1), lengths, np.repeat(np.arange(len(texts)), counts))


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a separator, and where each begins and the last ends; null is empty."""
    empty, separator = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    ended = pc.binary_join_element_wise(texts.cast(pa.large_string()), empty, separator, null_handling="replace", null_replacement="")
    offsets = np.frombuffer(ended.buffers()[1], np.int64, len(ended) + 1, ended.offset * 8)
    data = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(texts: pa.Array, limit: int = BUFFER_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of texts of at most ``limit`` bytes together, or one longer text, with the number of the first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        taken = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")) - at)
        yield at, texts.slice(at, taken)
        at += taken


def _lanes(data: np.ndarray, dtype: str) -> np.ndarray:
    """The number at every byte of a padded buffer."""
    width = np.dtype(dtype).itemsize
    return np.ndarray((len(data) - width + 1,), dtype, np.ascontiguousarray(data), strides=(1,))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray) -> np.ndarray:
    return _turned(lane * _P2, 31) * _P1


def _hash_equal_lengths(eights: np.ndarray, fours: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """XXH64 with seed 0 of the spans of one length."""
    done = 0
    if length >= 32:
        state = [np.full(len(at), s, np.uint64) for s in (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
        for done in range(0, length - 31, 32):
            for i in range(4):
                state[i] = _turned(state[i] + eights[at + (done + 8 * i)] * _P2, 31) * _P1
        done += 32
        h = _turned(state[0], 1) + _turned(state[1], 7) + _turned(state[2], 12) + _turned(state[3], 18)
        for s in state:
            h = (h ^ _round(s)) * _P1 + _P4
    else:
        h = np.full(len(at), _P5, np.uint64)
    h += np.uint64(length)
    while done + 8 <= length:
        h = _turned(h ^ _round(eights[at + done]), 27) * _P1 + _P4
        done += 8
    if done + 4 <= length:
        h = _turned(h ^ (fours[at + done] * _P1), 23) * _P2 + _P3
        done += 4
    for i in range(done, length):
        h = _turned(h ^ (data[at + i].astype(np.uint64) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """XXH64 of spans that are sorted by length."""
    out = np.empty(len(starts), np.uint64)
    eights, fours = _lanes(data, "<u8"), _lanes(data, "<u4")
    edges = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]])
    with np.errstate(over="ignore"):
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            length = int(lengths[a])
            if length > LONG:
                out[a:b] = [xxhash.xxh64_intdigest(data[s : s + length].tobytes()) for s in starts[a:b].tolist()]
            else:
                out[a:b] = _hash_equal_lengths(eights, fours, data, starts[a:b], length)
    return out


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the spans at ``a`` and ``b``, of ascending equal lengths, hold the same bytes."""
    same = np.ones(len(a), bool)
    eights = _lanes(data, "<u8")
    long = int(np.searchsorted(lengths, LONG, side="right"))
    longest = int(lengths[long - 1]) if long else 0
    for at in range(0, longest, 8):
        first = int(np.searchsorted(lengths[:long], at, side="right"))
        rest = np.minimum(lengths[first:long] - at, 8)
        same[first:long] &= ((eights[a[first:long] + at] ^ eights[b[first:long] + at]) & _MASKS[rest]) == 0
    for i in range(long, len(a)):
        same[i] = a[i] == b[i] or bool((data[a[i] : a[i] + lengths[i]] == data[b[i] : b[i] + lengths[i]]).all())
    return same


class Table(NamedTuple):
    """``slot`` of every span, ``used`` slots, the span that ``owner`` names for a slot, and the number of spans in it."""

    slot: np.ndarray
    used: np.ndarray
    owner: np.ndarray
    count: np.ndarray


def intern(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None) -> Table:
    """One slot for each different span; ``keys`` only stand in for the hashes in tests."""
    order = np.argsort(lengths.astype(np.uint16), kind="stable") if lengths.max(initial=0) < 1 << 16 else np.argsort(lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    keys = hashes(data, starts, lengths) if keys is None else keys[order]
    size = 1 << max(4, int(2 * len(starts)).bit_length())
    place = (keys & np.uint64(size - 1)).astype(np.int32)
    owner = np.full(size, -1, np.int32)
    slot = np.empty(len(starts), np.int32)
    pending = np.arange(len(starts), dtype=np.int32)
    while len(pending):
        at = place[pending]
        free = owner[at] < 0
        owner[at[free]] = pending[free]  # of several claims on a place one stays
        held = owner[at]
        equal = held == pending
        other = np.flatnonzero(~equal)
        a, b = held[other], pending[other]
        alike = np.flatnonzero((keys[a] == keys[b]) & (lengths[a] == lengths[b]))
        a, b = a[alike], b[alike]
        equal[other[alike]] = _same_bytes(data, starts[a], starts[b], lengths[b])
        slot[pending[equal]] = at[equal]
        pending = pending[~equal]
        place[pending] = (place[pending] + 1) & (size - 1)
    by_span = np.empty_like(slot)
    by_span[order] = slot
    used = np.flatnonzero(owner >= 0)
    named = np.full(size, -1, np.int32)
    named[used] = order[owner[used]]
    return Table(by_span, used, named, np.bincount(slot, minlength=size))


def _crc_shifts(lengths: int) -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 step for one byte, and for every length up to ``lengths`` what each byte of a CRC becomes after that many bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1).astype(np.uint32)
    shifts = np.empty((lengths + 1, 4, 256), np.uint32)
    shifts[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(lengths):
        shifts[n + 1] = step[shifts[n] & 255] ^ (shifts[n] >> 8)
    return step, shifts


_STEP, _SHIFTS = _crc_shifts(LONG)
_CRC_SPACE = np.uint32(zlib.crc32(b" "))


def _shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a CRC contributes once ``lengths`` (at most ``LONG``) more bytes follow."""
    out = _SHIFTS[lengths, 0, crc & 255]
    for i in (1, 2, 3):
        out ^= _SHIFTS[lengths, i, (crc >> np.uint32(8 * i)) & 255]
    return out


class Ngrams(NamedTuple):
    """The n-grams of one length in a stretch of words: text number per occurrence, its table, and CRC-32 and size of each slot's bytes."""

    text: np.ndarray
    table: Table
    crc: np.ndarray  # by slot


def _crc_of_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    order = np.argsort(lengths, kind="stable")
    starts, ordered = starts[order], lengths[order]
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(ordered, LONG, side="right"))
    for i in range(int(ordered[long - 1]) if long else 0):
        first = int(np.searchsorted(ordered[:long], i, side="right"))
        state[first:long] = _STEP[(state[first:long] ^ data[starts[first:long] + i]) & 255] ^ (state[first:long] >> 8)
    out = np.empty_like(state)
    out[order] = ~state
    out[order[long:]] = [zlib.crc32(data[a : a + n]) for a, n in zip(starts[long:].tolist(), ordered[long:].tolist(), strict=True)]
    return out


def ngrams(texts: pa.Array, longest: int) -> Iterator[Ngrams]:
    """All runs of 1 to ``longest`` words of every text, in tables of at most ``WORDS`` n-grams of one length.

    A CRC is taken of the different words alone; those of longer n-grams follow from the
    words' by the shift of the first part's CRC over the bytes that come after it.
    """
    words = cut_words(texts)
    total = len(words.starts)
    for low in range(0, total, WORDS):
        high = min(total, low + WORDS + longest - 1)
        starts, lengths, text = words.starts[low:high], words.lengths[low:high], words.text[low:high]
        begins = min(WORDS, total - low)  # n-grams that begin here; the words behind only end them
        table = intern(words.bytes, starts, lengths)
        crc = np.zeros(len(table.owner), np.uint32)
        own = table.owner[table.used]
        crc[table.used] = _crc_of_spans(words.bytes, starts[own], lengths[own])
        word_crc = crc[table.slot]
        if begins < len(starts):
            count = np.bincount(table.slot[:begins], minlength=len(table.owner))
            yield Ngrams(text[:begins], Table(table.slot[:begins], table.used, table.owner, count), crc)
        else:
            yield Ngrams(text, table, crc)
        for n in range(2, longest + 1):
            first = np.arange(min(begins, max(0, len(starts) - n + 1)))
            first = first[text[first] == text[first + n - 1]]
            if not len(first):
                break
            at, size = starts[first], starts[first + n - 1] + lengths[first + n - 1] - starts[first]
            table = intern(words.bytes, at, size)
            own = table.owner[table.used]
            crc = np.zeros(len(table.owner), np.uint32)
            crc[table.used] = _joined_crc(words.bytes, starts, lengths, word_crc, first[own], n)
            yield Ngrams(text[first], table, crc)


def _joined_crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, word_crc: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    out = word_crc[first]
    short = np.ones(len(first), bool)
    for i in range(1, n):
        short &= lengths[first + i] < LONG
    fits = np.flatnonzero(short)
    joined, at = out[fits], first[fits]
    for i in range(1, n):
        size = lengths[at + i]
        joined = _shifted(joined, size + 1) ^ _shifted(np.full(len(at), _CRC_SPACE), size) ^ word_crc[at + i]
    out[fits] = joined
    rest = np.flatnonzero(~short)
    if len(rest):
        at, last = first[rest], first[rest] + n - 1
        out[rest] = _crc_of_spans(data, starts[at], starts[last] + lengths[last] - starts[at])
    return out
