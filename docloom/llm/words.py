"""Vectorised word hashing over Arrow string arrays.

A word is a maximal run of ASCII letters (folded to lower case), ASCII digits
and characters above ASCII. In UTF-8 every byte of such a character is 0x80 or
more, so words, their starts and their hashes come from byte tables and prefix
sums, without a Python object per word. A word's hash depends on its bytes
alone: sum of R[byte] * P**k over its bytes, modulo 2**64, then mixed.

Null and empty texts have no words. Work is cut into slices of bounded bytes
(a longer single text is a slice of its own).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_PINV = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _P + _U(seed)) | _U(1)


_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 0x41) & (_BYTE <= 0x5A), _BYTE + 0x20, _BYTE).astype(np.uint8)
_IS_WORD = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)
_R = constants(256, 11)[_LOWER]
_POWERS = {_P: np.ones(1, _U), _PINV: np.ones(1, _U)}


def powers(base, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls up to the slice size."""
    have = _POWERS[base]
    if len(have) < n:
        x = np.full(n, base, _U)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """The words of a slice of texts: ``h`` (hash), ``doc`` (text index in the
    slice), ``first`` (index of each text's first word, one more at the end),
    ``start``/``end`` (byte offsets in ``data``), ``off`` (each text's bytes)."""

    def __init__(self, texts: pa.Array):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], wide, n + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64) \
            if n else np.zeros(1, np.int64)
        buf = texts.buffers()[2] if n else None
        data = np.frombuffer(buf, np.uint8, off[-1] - off[0], off[0]) if buf is not None and off[-1] > off[0] \
            else np.zeros(0, np.uint8)
        off = off - off[0]
        m = len(data)
        inside = _IS_WORD[data]
        cut = np.zeros(m + 1, bool)
        cut[off] = True
        before = np.zeros(m, bool)
        before[1:] = inside[:-1] & ~cut[1:m]
        after = np.zeros(m, bool)
        after[:-1] = inside[1:] & ~cut[1:m]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.data, self.off, self.n_texts = data, off, n
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        with np.errstate(over="ignore"):
            sums = np.zeros(m + 1, _U)
            np.cumsum(_R[data] * powers(_P, m) if m else np.zeros(0, _U), out=sums[1:])
            self._sums = sums
            self.h = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, equal for equal (case-folded) bytes wherever they stand."""
        with np.errstate(over="ignore"):
            inv = powers(_PINV, len(self.data) + 1)
            return mix((self._sums[end] - self._sums[start]) * inv[start] + (end - start).astype(_U))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, offsets, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words at ``i + offsets`` (ascending, from 0) for every
        i whose words all stand in one text; and those i."""
        span = offsets[-1] + 1
        n = len(self.h) - span + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        c = constants(len(offsets), seed)
        with np.errstate(over="ignore"):
            out = np.zeros(n, _U)
            for o, k in zip(offsets, c):
                out += self.h[o:o + n] * k
            at = np.flatnonzero(self.doc[:n] == self.doc[span - 1:])
            return mix(out[at]), at

    def digests(self, seeds=(3, 5)) -> list[np.ndarray]:
        """For each seed a hash of each text's whole word sequence."""
        out = []
        n = len(self.h)
        with np.errstate(over="ignore"):
            p, inv = powers(_P, n + 1), powers(_PINV, n + 1)
            for s in seeds:
                sums = np.zeros(n + 1, _U)
                np.cumsum(mix(self.h + constants(1, s)[0]) * p[:n], out=sums[1:])
                a, b = self.first[:-1], self.first[1:]
                out.append(mix((sums[b] - sums[a]) * inv[a] + (b - a).astype(_U) + _U(s)))
        return out


def word_hashes(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.string())).h


def release() -> None:
    """Give memory that is free back to the system: a worker lives on, idle,
    after its task, beside whatever the executor runs next."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc; elsewhere the allocator decides by itself


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Consecutive slices of at most ``most`` bytes (or one text). After the last one freed memory is given back."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size)
    i = 0
    while i < n:
        base = at[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(at, base + most, "right")))
        yield texts.slice(i, j - i)
        i = j
    release()


def lists(values: np.ndarray, per: np.ndarray, kind) -> pa.Array:
    """An Arrow list array with ``per[i]`` of the values in row i."""
    off = np.zeros(len(per) + 1, np.int32)
    np.cumsum(per, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
