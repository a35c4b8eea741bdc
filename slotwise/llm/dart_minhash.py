"""DartMinHash signatures of weighted sets, vectorised over many sets.

Darts fall on the plane (weight, rank) of every element as a Poisson process of rate 1, fixed by the
element's hash. A set sees the darts below its elements' weights; each dart belongs to one of k coordinates,
and a coordinate keeps its dart of least rank. Two sets keep the same dart with the probability of their
weighted Jaccard similarity. Only ranks below phi = (k ln k + 2k) / (total weight) are thrown, about
k ln k + 2k darts a set whatever its size; a set with an empty coordinate throws again with phi doubled.

The plane is cut into cells of area 1: weight bands [0, 1), [1, 2), [2, 4), ..., each with strips of rank as
high as the band is narrow. A cell's number of darts and their places follow from (element, band, strip).
"""

from __future__ import annotations

import math

import numpy as np

from slotwise.llm.textblock import U64, mix

#: P(at most n darts in a cell), n from 0: the Poisson distribution of mean 1.
_AT_MOST = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes."""
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, phi: np.ndarray, n: int, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Least rank and its dart for each (set, coordinate) below each set's phi."""
    band_of = np.zeros(len(doc), np.int64)
    big = weight > 1
    band_of[big] = np.ceil(np.log2(weight[big])).astype(np.int64)
    item = np.repeat(np.arange(len(doc)), band_of + 1)
    band = np.arange(len(item)) - np.repeat(np.cumsum(band_of + 1) - band_of - 1, band_of + 1)
    low = np.where(band == 0, 0.0, 2.0 ** (band - 1))
    width = np.where(band == 0, 1.0, low)
    strips = np.maximum(1, np.ceil(phi[doc[item]] * width)).astype(np.int64)
    cell = np.repeat(np.arange(len(item)), strips)
    strip = np.arange(len(cell)) - np.repeat(np.cumsum(strips) - strips, strips)
    with np.errstate(over="ignore"):
        key = mix(element[item[cell]] + mix(strip.astype(U64) * U64(64) + band[cell].astype(U64) + U64(seed << 8)))
    darts = np.searchsorted(_AT_MOST, _unit(key), "right")
    at = np.repeat(np.arange(len(cell)), darts)
    number = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
    with np.errstate(over="ignore"):
        dart = mix(key[at] + (number + 1).astype(U64) * U64(0x9E3779B97F4A7C15))
        place = mix(dart + U64(1))
    own = cell[at]
    rank = (strip[at] + _unit(dart)) / width[own]
    high = low[own] + _unit(place) * width[own]
    of = doc[item[own]]
    seen = (high < weight[item[own]]) & (rank < phi[of])
    rank, dart = rank[seen], dart[seen]
    slot = of[seen] * k + (mix(place[seen]) % U64(k)).astype(np.int64)
    least = np.full(n * k, np.inf)
    np.minimum.at(least, slot, rank)
    best = rank == least[slot]
    kept = np.full(n * k, _EMPTY, U64)
    kept[slot[best]] = dart[best]
    return least.reshape(n, k), kept.reshape(n, k)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """k kept darts (64-bit) for each of n sets; ``doc`` says whose each (distinct) element is. Empty sets keep none (all ones)."""
    total = np.bincount(doc, weight, n)
    out = np.full((n, k), _EMPTY, U64)
    todo = np.flatnonzero(total > 0)
    darts = k * math.log(k) + 2 * k
    while len(todo):
        number = np.full(n, -1)
        number[todo] = np.arange(len(todo))
        mine = number[doc] >= 0
        _, out[todo] = _throw(number[doc[mine]], element[mine], weight[mine], darts / total[todo], len(todo), k, seed)
        todo = todo[(out[todo] == _EMPTY).any(1)]
        darts *= 2
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    n, k = signature.shape
    n_bands = k // rows
    key = np.tile(mix(np.arange(1, n_bands + 1, dtype=U64)), (n, 1))
    parts = signature[:, : n_bands * rows].reshape(n, n_bands, rows)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key + parts[:, :, r])
    return key
