"""Hashes of the runs of words of whole batches of texts, for Arrow functions.

A word is hashed by a table of random numbers for its bytes and their places, a run by its words' hashes. The numbers are made of their
indexes, so that all workers have the same."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
#: Bytes of text that are hashed at once; what is made of them is some sixty times that.
CHUNK = 1 << 18
PLACES = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits to others, one to one, all bits of which depend on all bits."""
    x = x.astype(np.uint64)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


def _numbers(n: int, kind: int) -> np.ndarray:
    return mixed(mixed(np.arange(1, n + 1) + (kind << 40)) + np.uint64(0x9E3779B97F4A7C15))


_BYTES = _numbers(PLACES * 256, 1)


def _words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place in data of every word; begins: where texts begin, which no word crosses."""
    full = ~BLANK[data]
    cut = np.ones(len(data) + 1, bool)
    cut[1:-1] = ~full[:-1]
    cut[begins] = True
    starts = np.flatnonzero(full & cut[:-1])
    if not len(starts):
        return np.empty(0, np.uint64), starts
    at = np.flatnonzero(full)
    first = np.cumsum(full)[starts] - 1
    lengths = np.diff(first, append=len(at))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    value = _BYTES[((place & PLACES - 1) << 8) + data[at]]
    if lengths.max() > PLACES:
        later = _numbers(int(lengths.max()) // PLACES + 1, 2) | np.uint64(1)
        later[0] = 1  # words hash to the same beside longer ones
        value *= later[place // PLACES]
    return mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64)), starts


def _runs(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Hashes of the runs of each text, in order, with repeats."""
    w, starts = _words(data, offsets[:-1])
    ends = np.searchsorted(starts, offsets)
    first, n = ends[:-1], np.diff(ends)
    factors = _numbers(k, 3) | np.uint64(1)
    w = np.append(w, np.zeros(k, np.uint64))
    runs = np.zeros(len(w) - k, np.uint64)
    for j in range(k):
        runs += w[j : len(w) - k + j] * factors[j]
    runs, short, few = mixed(runs), np.zeros(len(n), np.uint64), _numbers(k + 1, 4)
    for j in range(k):
        short += np.where(j < n, w[np.minimum(first + j, len(w) - 1)] * factors[j], np.uint64(0))
    short = mixed(short + few[np.minimum(n, k)])
    for i, (a, m) in enumerate(zip(first.tolist(), n.tolist(), strict=True)):
        yield runs[a : a + m - k + 1] if m >= k else short[i : i + min(m, 1)]


def sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes (64 bits, signed) of the runs of k words of each text; a text with fewer words is one run, none without
    words. Texts mustn't be null."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        for runs in _runs(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k):
            h = np.sort(runs.view(np.int64))
            yield h[np.append(True, h[1:] != h[:-1])] if len(h) > 1 else h
        i = j
