"""Hashes of words and word runs over whole batches of texts, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd 64-bit numbers, one for bytes in words and one for words in runs.
BYTE_BASE, WORD_BASE = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Texts are hashed together up to this many bytes.
GROUP_BYTES = 1 << 20
#: Bytes are hashed in pieces of about this length, cut where a word begins.
PIECE_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64."""

    def __init__(self, base: np.uint64):
        self.base = base
        self.inverse = U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, self.base, dtype=U), np.full(size, self.inverse, dtype=U)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if size > 1 << 23:
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


BYTES, WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


def run_sums(values: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which the hash of any run follows, and the powers to shift it."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def run_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` up to ``end``, whatever stands before them."""
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))


@dataclass
class Group:
    """Words of some texts in order: hash, bytes from start to end, and the text each is in."""

    rows: range
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray  # position of the text within the group
    first: np.ndarray  # by text: its first word; one more entry at the end


def word_groups(texts: list[str | None], lower: bool = False) -> Iterator[Group]:
    """Words of a batch, in groups of whole texts of about GROUP_BYTES."""
    at = 0
    while at < len(texts):
        raw, size, end = [], 0, at
        while end < len(texts) and (end == at or size < GROUP_BYTES):
            piece = (texts[end] or "").encode()
            raw.append(piece)
            size += len(piece) + 1
            end += 1
        yield hash_group(range(at, end), raw, lower)
        at = end


def hash_group(rows: range, raw: list[bytes], lower: bool) -> Group:
    data = np.frombuffer(b"\n".join(raw), dtype=np.uint8)
    bounds = np.cumsum([len(r) + 1 for r in raw])
    if lower:
        data = LOWER[data]
    gap = SPACE[data]
    edge = np.diff(np.concatenate(([1], gap, [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), dtype=U)
    low = 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + PIECE_BYTES)))
        base = starts[low]
        sums, down = run_sums(data[base : ends[high - 1]].astype(U) + U(1), BYTES)
        hashes[low:high] = run_hash(sums, down, starts[low:high] - base, ends[low:high] - base)
        low = high
    text = np.searchsorted(bounds, starts, side="right")
    first = np.searchsorted(text, np.arange(len(raw) + 1))
    return Group(rows, hashes, starts, ends, text, first)


def run_bytes(group: Group, begin: np.ndarray, size: int) -> np.ndarray:
    """Bytes of the runs of ``size`` words from ``begin`` on, with one blank between words whatever the text has."""
    sums = np.concatenate(([0], np.cumsum(group.ends - group.starts)))
    return sums[begin + size] - sums[begin] + (size - 1)


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
