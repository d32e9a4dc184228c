"""DartMinHash signatures of weighted sets, for a batch of sets at once.

Every element owns a fixed random scatter of darts over the plane of weight x
rank (one dart a unit of area on average), decided by hashes of the element
alone. A set keeps the darts that stand below its elements' weights. Each dart
belongs to one of ``k`` coordinates, and a coordinate's value is its earliest
dart (smallest rank). Two sets agree on a coordinate with a probability equal
to their weighted Jaccard similarity. Only darts of a rank up to about
(k ln k + 2k) / total weight are thrown, so the work is in proportion to the
elements plus k log k; sets that leave a coordinate empty are thrown again up
to twice the rank.
"""

from __future__ import annotations

import math

import numpy as np

from docloom.llm.words import constants, mix

_U = np.uint64
_TWO53 = 2.0 ** -53
_FIRST = -6                      # the lowest rank band is [0, 2**_FIRST); then bands double


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> _U(11)).astype(np.float64) * _TWO53


def _poisson_cdf(mean: float) -> np.ndarray:
    top = int(mean + 12 * math.sqrt(mean) + 20)
    logs = -mean + np.arange(top) * math.log(mean) - np.array([math.lgamma(i + 1) for i in range(top)])
    return np.cumsum(np.exp(logs))


_CDF: dict[int, np.ndarray] = {}


def _throw(sig, doc, elem, cell, limit, reach, k, seed) -> None:
    """Lower ``sig`` by the darts of rank under ``reach[doc]``; a dart counts
    if it stands below ``limit`` in its unit cell of the weight axis."""
    c = constants(4, seed)
    band, low = _FIRST, 0.0
    own = mix(elem * c[0] + cell.astype(_U) * c[1])
    flat = sig.reshape(-1)
    while True:
        live = np.flatnonzero(reach[doc] > low) if low else np.arange(len(doc))
        if not len(live):
            return
        high = 2.0 ** band
        if band not in _CDF:
            _CDF[band] = _poisson_cdf(high - low)
        start = mix(own[live] + _U(band - _FIRST + 1) * c[2])
        n = np.searchsorted(_CDF[band], _unit(start), "right")
        some = np.flatnonzero(n)
        live, start, n = live[some], start[some], n[some]
        for lo in range(0, len(live), 1 << 18):          # bounded memory for sets of few elements, that need many darts
            part = slice(lo, lo + (1 << 18))
            m = n[part]
            at = np.repeat(np.arange(len(m)), m)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
            dart = mix(start[part][at] + (nth + 1).astype(_U) * c[3])
            rank = low + (high - low) * _unit(dart)
            which = live[part][at]
            dart = mix(dart)
            ok = (rank < reach[doc[which]]) & (_unit(dart) < limit[which])
            which, rank = which[ok], rank[ok]
            dart = mix(dart[ok])
            value = (rank * 2.0 ** 32).astype(_U) << _U(20) | dart >> _U(44)
            np.minimum.at(flat, doc[which] * k + (dart % _U(k)).astype(np.int64), value)
        low, band = high, band + 1


def signatures(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n_docs: int, k: int, seed: int = 7) -> np.ndarray:
    """(n_docs, k) uint64 signatures of the sets given as (doc, elem, weight)
    triples, ``doc`` ascending and each (doc, elem) once; all ones for a doc
    without elements of a positive weight."""
    empty = np.iinfo(np.uint64).max
    sig = np.full((n_docs, k), empty, _U)
    cells = np.maximum(np.ceil(weight), 0).astype(np.int64)
    with np.errstate(over="ignore"):
        at = np.repeat(np.arange(len(doc)), cells)
        cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
        d, e = doc[at], elem[at]
        limit = weight[at] - cell
        total = np.bincount(doc, weight, n_docs)
        reach = np.where(total > 0, (k * math.log(k) + 2 * k) / np.where(total > 0, total, 1), 0.0)
        _throw(sig, d, e, cell, limit, reach, k, seed)
        while True:
            again = (sig == empty).any(1) & (total > 0)
            if not again.any():
                return sig
            reach = np.where(again, reach * 2, reach)
            mine = np.flatnonzero(again[d])
            _throw(sig, d[mine], e[mine], cell[mine], limit[mine], reach, k, seed)


def bands(sig: np.ndarray, n_bands: int, seed: int = 13) -> np.ndarray:
    """(n_docs, n_bands) hashes of equal runs of coordinates, the band's number mixed in."""
    n, k = sig.shape
    rows = k // n_bands
    c = constants(n_bands, seed)
    with np.errstate(over="ignore"):
        out = np.tile(c, (n, 1))
        for r in range(rows):
            out = mix(out + sig[:, r:rows * n_bands:rows])
    return out
