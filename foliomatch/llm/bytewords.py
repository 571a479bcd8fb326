"""Words and CRC-32 sums of whole columns of texts by automata over their UTF-8 bytes, many texts at a time.

A table of 256 entries says which bytes belong to words; where a byte belongs and its neighbour doesn't, a word
begins or ends. The CRC registers of all words advance together, a byte a step, by the usual table; words that are
over leave the step. Nothing is decoded and no loop runs over words, but for those longer than ``LONG`` bytes."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes up to which words advance together; the few longer ones go to zlib one by one, so that they cost no steps.
LONG = 64
START = np.uint32(0xFFFFFFFF)
#: Capitals A-Z to small letters; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def crc_table() -> np.ndarray:
    """The registers that single bytes lead to, by the reflected polynomial of zlib's CRC-32."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = crc_table()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large strings (none null) without a copy, and the place in them where each text begins (one more at the end)."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


class Found(NamedTuple):
    """Words of texts: where they begin and end, and the text of each."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def words(inside: np.ndarray, bounds: np.ndarray, alone: np.ndarray | None = None) -> Found:
    """Maximal runs of bytes that are inside, none beyond its text. alone: which of these are words by themselves."""
    n = len(inside)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[bounds[:-1]] = True  # of texts; at n nothing is inside
    last[bounds[1:]] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    if alone is not None:
        before &= ~alone
        before[1:] &= ~alone[:-1]
        after &= ~alone
        after[:-1] &= ~alone[1:]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    ends = np.flatnonzero(inside & (~after | last[1:])) + 1
    return Found(starts, ends, np.searchsorted(bounds, starts, side="right") - 1)


def step(registers: np.ndarray, byte) -> np.ndarray:
    """The registers one byte on."""
    return TABLE[(registers ^ byte) & np.uint32(255)] ^ (registers >> np.uint32(8))


def advance(registers: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The registers after data[start : start + length] each. A CRC-32 is the register's complement."""
    short = np.minimum(lengths, LONG + 1)
    order = np.argsort((LONG + 1 - short).astype(np.uint8), kind="stable")  # the longest first
    left = len(short) - np.cumsum(np.bincount(short, minlength=LONG + 2))  # how many are longer than k bytes
    at, state = starts[order], registers[order]
    many = int(left[LONG])
    for i in range(many):
        a = int(at[i])
        state[i] = ~np.uint32(zlib.crc32(data[a : a + int(lengths[order[i]])], int(~state[i])))
    for k in range(LONG):
        end = int(left[k])
        if end == many:
            break
        state[many:end] = step(state[many:end], data[at[many:end] + k])
    out = np.empty_like(state)
    out[order] = state
    return out


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves, as large strings."""
    if not len(starts):
        return pa.array([], pa.large_string())
    offsets = np.stack([starts, ends], 1).ravel().astype(np.int64)  # words and what lies between them, in turn
    both = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    return both.take(pa.array(np.arange(0, len(offsets) - 1, 2)))
