"""Recompression: rounds that name token runs and token pairs the same way everywhere.

A round first replaces each maximal run ``a a a`` by one symbol named by (a, length),
then each pair ``a b`` whose first symbol is on the round's left side and whose second is
on its right side by one symbol named by (a, b).  A name is a 64-bit fingerprint of what it
stands for, so it is global without a dictionary that would have to be shuffled: equal
substrings get the same symbols in every text and on every executor, except within a few
symbols of their ends, where the text around them decides.
"""

from __future__ import annotations

import numpy as np

from quillspark.functions.arrowtext import WORD_BYTE, mix64, span_hashes

#: Rounds of run and pair naming, and the length in bytes above which no pair is joined.
ROUNDS, CAP = 6, 24
#: Of so many neighbouring seeds one is kept.
AMONG = 3
#: Runs of this many bytes mark where they begin and end: their own names tell only runs of one length apart.
LONG_RUN = 32
#: Words longer than this are broken into single bytes, so that a long unbroken text is parsed too.
LONG_TOKEN = 32

_A = np.uint64(0xD6E8FEB86659FD93)
_B = np.uint64(0xA0761D6478BD642F)


def first_symbols(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level 0: a word with what follows it up to the next word. Start byte, size, name."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, n))
    long = sizes > LONG_TOKEN
    if long.any():
        first[np.concatenate([np.arange(s, s + z) for s, z in zip(starts[long], sizes[long])])] = True
        starts = np.flatnonzero(first)
        sizes = np.diff(np.append(starts, n))
    return starts, sizes, span_hashes(data, starts, starts + sizes)


def rounds(starts: np.ndarray, sizes: np.ndarray, names: np.ndarray, rows: np.ndarray, many: int = ROUNDS, cap: int = CAP):
    """Symbols after ``many`` rounds: start byte, size, name, row; and the ends of long runs: byte, name, row.

    Two texts may share the inside of a run whose length differs; its two ends are named by the
    repeated symbol alone.
    """
    marks = ([starts[:0]], [names[:0]], [rows[:0]])
    for r in range(many):
        if len(names) < 2:
            break
        same = (names[1:] == names[:-1]) & (rows[1:] == rows[:-1])
        if same.any():
            head = np.append(True, ~same)
            at = np.flatnonzero(head)
            count = np.diff(np.append(at, len(names)))
            total = np.add.reduceat(sizes, at)
            run = count > 1
            name = names[at]
            name[run] = mix64(name[run] * _A + count[run].astype(np.uint64))
            long = run & (total >= LONG_RUN)
            if long.any():
                for place, kind in ((starts[at][long], 1), (starts[at][long] + total[long], 2)):
                    marks[0].append(place)
                    marks[1].append(mix64(names[at][long] * _B + np.uint64(kind)))
                    marks[2].append(rows[at][long])
            starts, sizes, names, rows = starts[at], total, name, rows[at]
        side = (mix64(names + np.uint64((r + 1) * int(_B) % (1 << 64))) >> np.uint64(63)).astype(bool)
        pair = side[:-1] & ~side[1:] & (rows[1:] == rows[:-1]) & (sizes[1:] + sizes[:-1] <= cap)
        left = np.flatnonzero(pair)
        names, sizes = names.copy(), sizes.copy()
        names[left] = mix64((names[left] ^ _B) * _A + names[left + 1])
        sizes[left] += sizes[left + 1]
        keep = np.ones(len(names), bool)
        keep[left + 1] = False
        starts, sizes, names, rows = starts[keep], sizes[keep], names[keep], rows[keep]
    return (starts, sizes, names, rows), tuple(np.concatenate(m) for m in marks)


def seeds(starts: np.ndarray, sizes: np.ndarray, names: np.ndarray, rows: np.ndarray, least: int, among: int = AMONG):
    """Shortest runs of neighbouring symbols of ``least`` bytes or more: start byte, size, name, row.

    Of every ``among`` neighbouring runs the one with the smallest name is kept, so about two in
    ``among + 1`` remain.  Which run is kept depends on nothing but the symbols, so two texts that
    share ``among`` neighbouring runs keep the same one of them.
    """
    n = len(names)
    ends = starts + sizes
    last = np.searchsorted(ends, starts + least, side="left")
    ok = last < n
    first, last = np.flatnonzero(ok), last[ok]
    ok = rows[first] == rows[last]
    first, last = first[ok], last[ok]
    powers = np.cumprod(np.full(n + 1, _A, np.uint64))
    inverse = np.uint64(pow(int(_A), -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * powers[:n])])
    name = (sums[last + 1] - sums[first]) * np.cumprod(np.full(n, inverse, np.uint64))[first] if n else names
    name, row, size, at = mix64(name), rows[first], ends[last] - starts[first], starts[first]
    m = len(name) - among + 1
    if among > 1 and m > 0:
        best = np.arange(m)
        for j in range(1, among):
            best = np.where(name[j : j + m] < name[best], np.arange(j, j + m), best)
        whole = row[:m] == row[among - 1 :]
        keep = np.zeros(len(name), bool)
        keep[best[whole]] = True
        few = np.bincount(row) < among  # a text with fewer runs keeps them all
        keep |= few[row]
        at, size, name, row = at[keep], size[keep], name[keep], row[keep]
    return at, size, name, row
