"""Compressed integer sets: a sorted list of 16-bit values where they are few, runs where they are long, else a bitmap.

Values are split by their upper bits into containers of 65,536, so a set of any 32-bit range stays small. Form of a
container: high part (4 bytes), kind (1 byte), length of the payload (4 bytes), payload.
"""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype([("high", "<u4"), ("kind", "u1"), ("size", "<u4")])
LIST, BITS, RUNS = 0, 1, 2


def encode(values: np.ndarray) -> bytes:
    """Bytes of the set of ``values`` (non-negative, below 2^32; repeats allowed)."""
    values = np.unique(np.asarray(values, dtype=np.uint32))
    out = []
    for high in np.unique(values >> 16):
        out.append(_container(int(high), (values[(values >> 16) == high] & 0xFFFF).astype(np.uint16)))
    return b"".join(out)


def _container(high: int, low: np.ndarray) -> bytes:
    """The smallest form of a container with the sorted values ``low``; nothing for none."""
    if low.size:
        cuts = np.flatnonzero(np.diff(low.astype(np.int32)) != 1)
        starts, ends = low[np.r_[0, cuts + 1]], low[np.r_[cuts, low.size - 1]]
        if 4 * starts.size < min(2 * low.size, 8192):
            kind, body = RUNS, np.stack([starts, ends - starts], axis=1).astype("<u2").tobytes()
        elif low.size <= 4096:
            kind, body = LIST, low.astype("<u2").tobytes()
        else:
            bits = np.zeros(65536, dtype=np.uint8)
            bits[low] = 1
            kind, body = BITS, np.packbits(bits, bitorder="little").tobytes()
        return np.array([(high, kind, len(body))], dtype=_HEAD).tobytes() + body
    return b""


def _containers(data: bytes | None):
    """(high, kind, body) of each container."""
    at = 0
    while data and at < len(data):
        head = np.frombuffer(data, _HEAD, 1, at)[0]
        at += _HEAD.itemsize
        yield int(head["high"]), int(head["kind"]), data[at : at + int(head["size"])]
        at += int(head["size"])


def _low(kind: int, body: bytes) -> np.ndarray:
    """The sorted values of a container."""
    if kind == LIST:
        return np.frombuffer(body, "<u2")
    if kind == BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8), bitorder="little")).astype(np.uint16)
    runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.uint32)
    lengths = runs[:, 1] + 1
    return (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(runs[:, 0], lengths)).astype(np.uint16)


def _bits(kind: int, body: bytes) -> np.ndarray:
    """A container as 8192 bytes of bits."""
    if kind == BITS:
        return np.frombuffer(body, np.uint8)
    if kind == RUNS:
        runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        edge = np.zeros(65537, np.int8)
        edge[runs[:, 0]] += 1
        edge[runs[:, 0] + runs[:, 1] + 1] -= 1
        return np.packbits(np.cumsum(edge[:-1]).astype(np.uint8), bitorder="little")
    flags = np.zeros(65536, np.uint8)
    flags[np.frombuffer(body, "<u2")] = 1
    return np.packbits(flags, bitorder="little")


def _held(low: np.ndarray, kind: int, body: bytes) -> np.ndarray:
    """Which of the sorted values ``low`` are in a container?"""
    if kind == BITS:
        bits = np.frombuffer(body, np.uint8)
        return (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 != 0
    if kind == RUNS:
        runs = np.frombuffer(body, "<u2").reshape(-1, 2).astype(np.int64)
        at = np.searchsorted(runs[:, 0], low.astype(np.int64), side="right") - 1
        return (at >= 0) & (low <= runs[at, 0] + runs[at, 1])
    other = np.frombuffer(body, "<u2")
    at = np.minimum(np.searchsorted(other, low), other.size - 1)
    return other[at] == low


def decode(data: bytes | None) -> np.ndarray:
    """The sorted values of an encoded set; none for null or empty bytes."""
    out = [_low(kind, body).astype(np.uint32) | (np.uint32(high) << np.uint32(16)) for high, kind, body in _containers(data)]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def and_not(a: bytes | None, b: bytes | None) -> bytes:
    """The encoded set of the values of ``a`` that are not in ``b``, container by container.

    Lists are looked up in the other container as it is; bitmaps and runs meet as words. A container of ``a`` alone is taken unchanged.
    """
    others = {high: (kind, body) for high, kind, body in _containers(b)}
    out = []
    for high, kind, body in _containers(a):
        if high not in others:
            out.append(np.array([(high, kind, len(body))], dtype=_HEAD).tobytes() + body)
        elif kind == LIST:
            low = np.frombuffer(body, "<u2")
            out.append(_container(high, low[~_held(low, *others[high])]))
        else:
            left = _bits(kind, body) & ~_bits(*others[high])
            if left.any():
                out.append(_container(high, _low(BITS, left.tobytes())))
    return b"".join(out)
