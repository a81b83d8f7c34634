"""BagMinHash signatures of word-shingle bags (weighted Jaccard).

A shingle of weight w owns the weights in [0, w). They are cut into dyadic
layers [0,1), [1,2), [2,4), [4,8), ... and on each layer runs a Poisson process
whose points carry a time, a place in the layer and a slot of the signature.
All of it follows from the shingle's hash and the layer, so bags that share a
shingle share the points below their common weight. Only the layer in which w
lies is thinned (points placed at w or above don't count), so a shingle of
weight a million costs twenty layers, not a million draws. The value of a slot
is the earliest point in it; two bags agree in a slot with a probability of
their weighted Jaccard similarity, the sum of the smaller weights by the sum
of the greater.

Points come in the order of time, so a bag needs only those before the time at
which its last slot fills: they are drawn up to a bound at which all slots are
most likely full, and further for the bags where one is not.
"""

from __future__ import annotations

import numpy as np

from .common import WordHashes, kept, mix, words

SHINGLE = 5
#: Bands and slots of a band. Bags of similarity 0.8 miss each other in all bands with probability 3e-6.
BANDS, ROWS = 24, 4
SLOTS = BANDS * ROWS

_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (hashes) of SHINGLE consecutive words and their
    counts; a text of fewer words, but not none, is one shingle."""
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = kept(("bagminhash",), WordHashes).of(ws)
    n = max(1, len(h) - SHINGLE + 1)
    out = h[:n] * _PRIMES[0]
    for j in range(1, min(SHINGLE, len(h))):
        out += h[j:j + n] * _PRIMES[j]
    return np.unique(mix(out), return_counts=True)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the smaller counts by the sum of the greater; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - both
    return both / either if either else 0.0


def _uniform(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def _layers(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray):
    """One row for each layer that a shingle's weight reaches: its seed, its
    width and how much of it the weight covers."""
    level, low, width = 0, 0, 1
    while len(elements):
        yield elements ^ mix(np.full(1, level + 1, np.uint64)), float(width), np.minimum(weights - low, width).astype(np.float64), owner
        low, width, level = (1, 1, 1) if level == 0 else (low + width, width * 2, level + 1)
        more = weights > low
        elements, weights, owner = elements[more], weights[more], owner[more]


#: Shingles of the bags that are drawn for at a time.
DRAWN = 300_000


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """For each bag (none empty) the times of the earliest points in its slots;
    an equal time is an equal point."""
    cut, held = [0], 0
    for i, b in enumerate(bags):
        if held and held + len(b[0]) > DRAWN:
            cut.append(i)
            held = 0
        held += len(b[0])
    return np.concatenate([_signatures(bags[i:j], slots) for i, j in zip(cut, [*cut[1:], len(bags)], strict=True)])


def _signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    layers = list(_layers(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]),
                          np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])))
    total = np.array([b[1].sum() for b in bags], np.float64)
    out = np.full(len(bags) * slots, np.inf)
    todo = np.ones(len(bags), bool)
    bound = (np.log(slots) + 2.5) * slots / total  # each slot sees a rate of total / slots
    while todo.any():
        for draw, width, covered, owner in layers:
            keep = np.flatnonzero(todo[owner])
            draw, covered, owner, time = draw[keep], covered[keep], owner[keep], 0.0
            while len(draw):
                draw = mix(draw)
                time = time - np.log(_uniform(draw)) / width
                early = np.flatnonzero(time <= bound[owner])
                draw, covered, owner, time = draw[early], covered[early], owner[early], time[early]
                point = mix(draw ^ np.uint64(0xD6E8FEB86659FD93))
                place = owner * slots + (point % np.uint64(slots)).astype(np.int64)
                if width > 1:  # below the weight?
                    inside = np.flatnonzero(_uniform(mix(point)) * width <= covered)
                    np.minimum.at(out, place[inside], time[inside])
                else:
                    np.minimum.at(out, place, time)
        todo = np.isinf(out).reshape(len(bags), slots).any(axis=1)
        bound = bound * 2
    return out.reshape(len(bags), slots)


def bands(signature: np.ndarray) -> np.ndarray:
    """Bucket ids of signatures: a row of BANDS 64-bit values for each."""
    parts = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = mix(out * _PRIMES[0] + parts[:, :, j])
    return out
