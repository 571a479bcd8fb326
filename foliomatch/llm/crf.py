"""A linear-chain conditional random field over sequences of tokens with three tags, in numpy.

Tags are OUTSIDE, BEGIN and INSIDE; a token's score for a tag is the sum of the weights of its features, which are ids into one
table. INSIDE never follows OUTSIDE nor begins a sequence. ``fit`` maximises the conditional likelihood of tags with
a small ridge by forward and backward sums and Adam's steps. ``viterbi`` finds the best tags of many sequences at
once, in whole numbers, so that results don't depend on how sequences are put together."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

OUTSIDE, BEGIN, INSIDE = range(3)
TAGS = 3
#: The score of what is ruled out.
NEVER = -(1 << 40)
#: Whole units of a weight of one.
UNIT = 1024
BLOCK = 256


class Weights(NamedTuple):
    """features: one row a feature id; steps: from tag to tag; first: of a sequence's first tag. As floats or whole units."""

    features: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def whole(self) -> Weights:
        return Weights(*(np.maximum(np.round(x * UNIT), NEVER).astype(np.int64) for x in self))


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradient(w: Weights, ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, ridge: float) -> tuple[float, Weights]:
    """Log-likelihood of tags less the ridge's share, and its gradient.

    ids: rows x tokens x features; tags, starts: rows x tokens. A start begins a new sequence within its row; a tag of -1 is
    no token, and must be a start."""
    n, length, _ = ids.shape
    there = tags >= 0
    own = np.where(there, tags, OUTSIDE)
    score = w.features[ids].sum(2)
    score[~there] = (0.0, NEVER, NEVER)
    ways = np.where(starts[:, :, None, None], w.first[None, None, None, :], w.steps[None, None])  # from, to
    ahead, back = np.empty((n, length, TAGS)), np.zeros((n, length, TAGS))
    ahead[:, 0] = w.first + score[:, 0]
    for t in range(1, length):
        ahead[:, t] = _lse(ahead[:, t - 1, :, None] + ways[:, t], 1) + score[:, t]
    for t in range(length - 2, -1, -1):
        back[:, t] = _lse(ways[:, t + 1] + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
    total = _lse(ahead[:, -1], 1)
    chance = np.exp(ahead + back - total[:, None, None])
    pair = np.exp(ahead[:, :-1, :, None] + ways[:, 1:] + (score[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None])
    rows, at = np.indices((n, length))
    begun = starts.copy()
    begun[:, 0] = True
    value = score[rows, at, own].sum() + w.first[own[begun]].sum() + w.steps[own[:, :-1], own[:, 1:]][~begun[:, 1:]].sum() - total.sum()
    miss = np.eye(TAGS)[own] - chance
    miss[~there] = 0
    g = np.stack([np.bincount(ids.ravel(), np.repeat(miss[:, :, k].ravel(), ids.shape[2]), len(w.features)) for k in range(TAGS)], 1)
    first = (np.eye(TAGS)[own] - chance)[begun].sum(0)
    inner = ~begun[:, 1:]
    steps = -pair[inner].sum(0)
    np.add.at(steps, (own[:, :-1][inner], own[:, 1:][inner]), 1)
    allowed_steps, allowed_first = w.steps > NEVER / 2, w.first > NEVER / 2
    value -= ridge / 2 * ((w.features**2).sum() + (w.steps[allowed_steps] ** 2).sum() + (w.first[allowed_first] ** 2).sum())
    return float(value), Weights(g - ridge * w.features, np.where(allowed_steps, steps - ridge * w.steps, 0), np.where(allowed_first, first - ridge * w.first, 0))


def fit(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, n_features: int, steps: int = 60, rate: float = 0.15, ridge: float = 0.05) -> Weights:
    """Weights for tagged rows (see ``gradient``). Feature 0 stands for nothing and keeps a weight of zero."""
    w = Weights(np.zeros((n_features, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS))
    w.steps[OUTSIDE, INSIDE] = w.first[INSIDE] = NEVER
    mean, square = ([np.zeros_like(x) for x in w] for _ in range(2))
    for t in range(1, steps + 1):
        _, g = gradient(w, ids, tags, starts, ridge)
        g.features[0] = 0
        for x, d, m, v in zip(w, g, mean, square, strict=True):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def viterbi(score: np.ndarray, starts: np.ndarray, w: Weights, block: int = BLOCK) -> np.ndarray:
    """The best tags of tokens (scores tokens x tags, whole units), whose sequences begin at starts; of equal ones the path with
    the smaller tags from the end.

    Tokens are cut into blocks that run side by side: first the best way through each block from every tag to every tag,
    then the blocks one after the other, then the tags within all blocks at once."""
    n = len(score)
    if not n:
        return np.zeros(0, np.int8)
    blocks = -(-n // block)
    padded = np.zeros((blocks * block, TAGS), np.int64)
    padded[:n], padded[n:, 1:] = score, NEVER
    begun = np.ones(blocks * block, bool)
    begun[:n] = starts
    begun[0] = True
    score = np.ascontiguousarray(padded.reshape(blocks, block, TAGS).transpose(1, 2, 0))  # place, tag, block
    begun = np.ascontiguousarray(begun.reshape(blocks, block).T)
    fresh = begun.any(1)

    def on(best: np.ndarray, t: int) -> np.ndarray:
        """best (..., from, block) one token on, as (..., to, block)."""
        out = (best[..., :, None, :] + w.steps[:, :, None]).max(-3)
        if fresh[t]:
            out = np.where(begun[t], best.max(-2)[..., None, :] + w.first[:, None], out)
        return out + score[t]

    through = np.full((TAGS, TAGS, blocks), NEVER, np.int64)
    through[range(TAGS), range(TAGS)] = 0
    for t in range(block):
        through = on(through, t)
    entry = np.zeros((TAGS, blocks), np.int64)
    for b in range(1, blocks):
        best = (entry[:, b - 1, None] + through[:, :, b - 1]).max(0)
        entry[:, b] = best - best.max()
    best, back = entry, np.empty((block, TAGS, blocks), np.int8)
    for t in range(block):
        came = (best[:, None, :] + w.steps[:, :, None]).argmax(0)
        back[t] = np.where(begun[t], best.argmax(0), came) if fresh[t] else came
        best = on(best, t)
    at = np.arange(blocks)
    entered = np.repeat(np.arange(TAGS)[:, None], blocks, 1)  # the tag before a block, for each tag at its end
    for t in range(block - 1, -1, -1):
        entered = back[t, entered, at]
    last = np.empty(blocks, np.int64)
    last[-1] = best[:, -1].argmax()
    for b in range(blocks - 1, 0, -1):
        last[b - 1] = entered[last[b], b]
    tags = np.empty((block, blocks), np.int8)
    for t in range(block - 1, -1, -1):
        tags[t] = last
        last = back[t, last, at]
    return tags.T.ravel()[:n]
