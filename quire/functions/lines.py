"""Changed lines of one text against an earlier one, as few as possible."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Pairing keeps the rows of a table of up to this many bits; larger ones are halved first.
TABLE_BITS = 1 << 27
#: Position masks of repeated lines are kept up to this many bytes.
MASK_BYTES = 1 << 26


def text_lines(text: str | None) -> list[str]:
    """Lines with their newlines, so that a last line without one differs from one with it."""
    pieces = (text or "").split("\n")
    return [p + "\n" for p in pieces[:-1]] + ([pieces[-1]] if pieces[-1] else [])


def changed_ranges(base: str | None, head: str | None) -> list[tuple[int, int]]:
    """``(start, count)`` of new lines, 1-based on the head side; a pure deletion is ``(line before it, 0)``.

    Replacing the ranges turns base into head, and no other choice of ranges has fewer changed lines. A deletion in
    front of a new line belongs to that line's range.
    """
    old, new = text_lines(base), text_lines(head)
    ranges = []
    above_old = above_new = -1
    for i, j in [*kept_lines(old, new), (len(old), len(new))]:
        if j - above_new > 1:
            ranges.append((above_new + 2, j - above_new - 1))
        elif i - above_old > 1:
            ranges.append((above_new + 1, 0))
        above_old, above_new = i, j
    return ranges


def kept_lines(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Positions of the lines that stay: a longest common subsequence.

    A common beginning and then a common end are kept; between them, of all longest ones, the one whose lines come first
    in ``new``, and of these the one with the last lines of ``old``. Lines that only one side has are left out
    before the search.
    """
    least = min(len(old), len(new))
    start = 0
    while start < least and old[start] == new[start]:
        start += 1
    end = 0
    while end < least - start and old[-1 - end] == new[-1 - end]:
        end += 1
    stop_old, stop_new = len(old) - end, len(new) - end
    shared = set(old[start:stop_old]) & set(new[start:stop_new])
    rows = [i for i in range(start, stop_old) if old[i] in shared]
    cols = [j for j in range(start, stop_new) if new[j] in shared]
    middle = [(rows[i], cols[j]) for i, j in _longest([old[i] for i in rows], [new[j] for j in cols])]
    return [*((i, i) for i in range(start)), *middle, *((stop_old + i, stop_new + i) for i in range(end))]


class _Columns:
    """Bit vectors of common lengths: bit j is 0 where one more column of ``new`` adds a line."""

    def __init__(self, new: Sequence):
        self.size = len(new)
        self.full = (1 << self.size) - 1
        self.places: dict = {}
        for j, line in enumerate(new):
            self.places.setdefault(line, []).append(j)
        self.masks: dict = {}

    def mask(self, line) -> int:
        known = self.masks.get(line)
        if known is not None:
            return known
        places = self.places.get(line, ())
        if len(places) < 3:
            return sum(1 << j for j in places)
        bits = bytearray(self.size // 8 + 1)
        for j in places:
            bits[j >> 3] |= 1 << (j & 7)
        mask = int.from_bytes(bits, "little")
        if len(self.masks) * len(bits) < MASK_BYTES:
            self.masks[line] = mask
        return mask

    def next(self, vector: int, line) -> int:
        held = vector & self.mask(line)
        return ((vector + held) | (vector - held)) & self.full


def _lengths(old: Sequence, new: Sequence) -> np.ndarray:
    """Common length of ``old`` and each prefix of ``new``."""
    columns = _Columns(new)
    vector = columns.full
    for line in old:
        vector = columns.next(vector, line)
    bits = np.unpackbits(np.frombuffer(vector.to_bytes(len(new) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[: len(new)].astype(np.int64))])


def _longest(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    """Halve ``old`` at the first column of ``new`` through which a longest path leads, until the table fits."""
    found, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        top, bottom, left, right = todo.pop()
        if top == bottom or left == right:
            continue
        if bottom - top > 1 and (bottom - top) * (right - left) > TABLE_BITS:
            middle = (top + bottom) // 2
            before = _lengths(old[top:middle], new[left:right])
            after = _lengths(old[middle:bottom][::-1], new[left:right][::-1])[::-1]
            cut = left + int(np.argmax(before + after))
            todo += [(top, middle, left, cut), (middle, bottom, cut, right)]
        else:
            found += [(top + i, left + j) for i, j in _walk(old[top:bottom], new[left:right])]
    return sorted(found)


def _walk(old: Sequence, new: Sequence) -> list[tuple[int, int]]:
    columns = _Columns(new)
    width = len(new) // 8 + 1
    vectors, vector = [], columns.full
    for line in old:
        vector = columns.next(vector, line)
        vectors.append(vector)
    found, j = [], len(new)
    for i in reversed(range(len(old))):
        if not j:
            break
        bits = vectors[i].to_bytes(width, "little")
        while j and bits[j - 1 >> 3] >> (j - 1 & 7) & 1:
            j -= 1
        if j and old[i] == new[j - 1]:
            j -= 1
            found.append((i, j))
    return found
