"""Column-wise construction of the suffix order of many short texts.

All texts advance together: each round puts one more symbol in front of every text's
last inserted suffix and inserts the suffixes so made.  Kept, in the order of the
suffixes: the symbol before each one with the place that it had (the collection's
Burrows-Wheeler transform, as a sorted list of symbol and place), and the length of the
common prefix with the one before, up to ``length``.  A round reads these three
sequences once, in order, and writes them once.

A new suffix is a symbol c and an older suffix x. Among the suffixes that begin with c it
stands where x stands among what c precedes, which one search in the sorted list gives;
its common prefix with a neighbour is one symbol longer than the least common prefix
between x and the neighbour's own rest.

Symbols are ``width`` bytes, so a text is read in up to ``width`` phases and the rounds
are as many times fewer. A caller's collection is bounded, so the sequences, which are
external files where a whole corpus is one collection, are arrays here.
"""

from __future__ import annotations

import numpy as np

_PLACE = np.int64((1 << 32) - 1)


def width_for(length: int) -> int:
    """The widest symbol, up to ten bytes, that divides ``length``."""
    return max(w for w in range(1, 11) if length % w == 0)


def symbols(data: np.ndarray, width: int) -> np.ndarray:
    """A number from 1 on for the ``width`` bytes at each place, equal for equal bytes only."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    head = np.ndarray((len(data),), "<u8", padded, strides=(1,)) & np.uint64((1 << 8 * min(8, width)) - 1)
    code = np.unique(head, return_inverse=True)[1]
    if width > 8:
        tail = np.ndarray((len(data),), "<u2", padded[8:], strides=(1,)) & np.uint16((1 << 8 * (width - 8)) - 1)
        code = np.unique(code << 16 | tail, return_inverse=True)[1]
    return (code + 1).astype(np.int32)


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] for each pair, by minima over runs of powers of two."""
    out = np.empty(len(first), values.dtype)
    level = (np.frexp((last - first + 1).astype(np.float32))[1] - 1).astype(np.uint8)
    by = np.argsort(level, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(level))])
    table, n = values, len(values)
    for k in range(len(cuts) - 1):
        at = by[cuts[k] : cuts[k + 1]]
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - ((1 << k) - 1)])
        n -= 1 << k
        if k + 2 < len(cuts):
            table = np.minimum(table[:n], table[1 << k : n + (1 << k)])
    return out


def suffix_order(data: np.ndarray, bounds: np.ndarray, counts: np.ndarray, length: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of suffixes of the texts data[bounds[i]:bounds[i + 1]] in suffix order, and for
    each whether its first ``length`` bytes are those of the one before it.

    Every one of the first ``counts[i]`` places of a text is among them, if ``length`` bytes
    follow each. Fewer than 2**31 bytes.
    """
    width = width or width_for(length)
    most = length // width
    sizes = np.diff(bounds)
    code = symbols(data, width)
    before = np.zeros(len(data) + 1, np.int32)
    before[width:-1] = code[:-width]
    before[:-1][np.arange(len(data)) - np.repeat(bounds[:-1], sizes) < width] = 0
    phases = np.minimum(width, counts)
    text = np.repeat(np.arange(len(counts)), phases)
    phase = np.arange(len(text)) - np.repeat(np.cumsum(phases) - phases, phases)
    rounds = (sizes[text] - phase) // width
    end = bounds[:-1][text] + phase + width * rounds
    n, total = len(end), len(end) + int(rounds.sum())
    # the empty suffixes come first and all equal; two copies of each sequence take turns
    keys, keys2 = np.zeros(total, np.int64), np.zeros(total, np.int64)
    common, common2 = np.zeros(total, np.uint8), np.zeros(total, np.uint8)
    place, place2 = np.zeros(total, np.int32), np.zeros(total, np.int32)
    scratch, older = np.zeros(total, np.int64), np.zeros(total, bool)
    place[:n] = end
    size, fresh, front = n, np.arange(n), code[end - width].astype(np.int64)
    for _ in range(int(rounds.max(initial=0))):
        new = np.sort((front << 32 | fresh)[front > 0])
        if not len(new):
            break
        at = np.searchsorted(keys[n:size], new) + np.arange(n, n + len(new))
        was, size = size, size + len(new)
        old = older[:size]
        old[:] = True
        old[at] = False
        keys2[n:size][old[n:]] = keys[n:was]
        keys2[at] = new
        rest, symbol = new & _PLACE, new >> 32
        above, after = keys2[at - 1], np.minimum(at + 1, size - 1)
        below = keys2[after]
        up = np.flatnonzero(above >> 32 == symbol)
        down = np.flatnonzero((at + 1 < size) & (below >> 32 == symbol) & old[after])
        least = range_minima(common[:was], np.concatenate([(above[up] & _PLACE) + 1, rest[down] + 1]), np.concatenate([rest[up], below[down] & _PLACE]))
        least = np.minimum(least.astype(np.int64) + 1, most).astype(np.uint8)
        made = place[rest] - width
        moved, live, where = np.flatnonzero(old), keys2[n:size], scratch[n:size]
        np.bitwise_and(live, _PLACE, out=where)
        live -= where
        live += moved.take(where, out=where, mode="clip")
        common2[:size][old] = common[:was]
        common2[at] = 0
        common2[at[up]] = least[: len(up)]
        common2[at[down] + 1] = least[len(up) :]
        place2[:size][old] = place[:was]
        place2[at] = made
        keys, keys2, common, common2, place, place2 = keys2, keys, common2, common, place2, place
        fresh, front = at, before[made].astype(np.int64)
    return place[n:size], common[n:size] >= most
