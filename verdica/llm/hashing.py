"""Vectorised word and window hashes of a batch of texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_WORD, _A, _B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)
_ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(_A)
    x = (x ^ (x >> _U(27))) * _U(_B)
    return x ^ (x >> _U(31))


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a byte string."""
    b = np.frombuffer(joined, np.uint8)
    inside = ((b != 32) & ((b < 9) | (b > 13))).view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in order, and the offsets of each text's first word (one more at the end)."""
    joined = b"\n".join(texts)
    starts, ends = word_bounds(joined)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    offsets = np.searchsorted(starts, first)
    loads = np.ndarray((len(joined) + 1,), "<u8", buffer=joined + bytes(8), strides=(1,))
    length = ends - starts
    h = length.astype(_U) * _U(_WORD)
    which, at = np.arange(len(starts)), 0
    while len(which):
        part = loads[starts[which] + at] & _LOW[np.minimum(length[which] - at, 8)]
        h[which] = mixed(h[which] ^ part)
        at += 8
        which = which[length[which] > at]
    return h, offsets


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` values, by doubling; empty when there are fewer values."""
    if len(h) < size:
        return h[:0]
    out, width, block, w = None, 0, h, 1
    while size:
        if size & 1:
            if out is None:
                out = block
            else:
                n = min(len(block), len(out) - w)
                out = block[:n] * _U(pow(base, width, 1 << 64)) + out[w : w + n]
            width += w
        size >>= 1
        if size:
            n = len(block) - w
            block = block[:n] * _U(pow(base, w, 1 << 64)) + block[w : w + n]
            w *= 2
    return out


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The low bytes of integers, plane by plane: what the shuffle's compressor can shrink lies together."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def unplaned(blob: bytes, n_bytes: int) -> np.ndarray:
    n = len(blob) // n_bytes
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(blob, np.uint8).reshape(n_bytes, n).T
    return out.reshape(-1).view("<u8")
