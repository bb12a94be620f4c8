"""How much of a passage's words a text holds, in order, small changes aside."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

#: A run of this many equal words stands for itself; shorter ones (three at least) count only near another run.
STRONG, WEAK = 6, 3
#: How far apart, in words of the passage and of the text, a short run may be from its neighbour.
NEAR_ITEM, NEAR_TEXT = 12, 24
#: Letters between two runs that are this similar count as the same wording (spelling or layout differs).
ALIKE = 0.6
#: Letters of a stretch that are compared at once.
PART = 400


def _blocks(item: list[str], text: list[str]) -> list[tuple[int, int, int]]:
    """Maximal runs of WEAK or more equal words: place in the item, in the text, length."""
    at = defaultdict(list)
    for i in range(len(item) - WEAK + 1):
        at[tuple(item[i : i + WEAK])].append(i)
    open_: dict[int, int] = {}
    found = []
    for j in range(len(text) - WEAK + 1):
        for i in at.get((text[j], text[j + 1], text[j + 2]), ()):
            k = open_.get(i - j)
            if k is not None and found[k][1] + found[k][2] - WEAK == j - 1:
                found[k][2] += 1
            else:
                open_[i - j] = len(found)
                found.append([i, j, WEAK])
    return [tuple(x) for x in found]


def _chain(blocks: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The heaviest sequence of runs that go forward in the item and in the text."""
    blocks = sorted(blocks, key=lambda b: (b[1], b[0]))
    best, back = [], []
    for n, (i, j, size) in enumerate(blocks):
        top, frm = size, -1
        for p in range(n):
            a, b, z = blocks[p]
            # runs may overlap by a word or two; what they share counts once
            over = max(0, a + z - i, b + z - j)
            if a < i and b < j and over < size and (gain := best[p] + size - over) > top:
                top, frm = gain, p
        best.append(top)
        back.append(frm)
    out = []
    n = max(range(len(best)), key=best.__getitem__) if best else -1
    while n >= 0:
        out.append(blocks[n])
        n = back[n]
    return out[::-1]


def _gap(a: list[str], b: list[str]) -> float:
    """How many words of ``a`` the stretch ``b`` stands for.

    Long stretches are compared in equal parts of about PART letters, so the cost is linear.
    """
    if not a or not b:
        return 0.0
    x, y = "".join(a), "".join(b)
    if not 0.4 < len(x) / len(y) < 2.5:
        return 0.0
    parts = -(-len(x) // PART)
    good = 0.0
    for k in range(parts):
        u, v = (t[len(t) * k // parts : len(t) * (k + 1) // parts] for t in (x, y))
        ratio = SequenceMatcher(None, u, v, autojunk=False).ratio()
        good += ratio if ratio >= ALIKE else 0.0
    return len(a) * good / parts


def share(item: list[str], text: list[str]) -> float:
    """The share of the item's words that the text holds in order (0..1).

    An empty item or text has share 0.  Runs of three to five equal words far from any other
    run are stock phrases and count nothing.
    """
    if not item or not text:
        return 0.0
    if len(item) < WEAK:
        return float(" ".join(item) in " ".join(text))
    chain = _chain(_blocks(item, text))
    kept = []
    for n, (i, j, z) in enumerate(chain):
        near = False
        for o in (n - 1, n + 1):
            if 0 <= o < len(chain):
                a, b, y = chain[o]
                lo, hi = ((a, b, y), (i, j, z)) if o < n else ((i, j, z), (a, b, y))
                near |= hi[0] - lo[0] - lo[2] <= NEAR_ITEM and hi[1] - lo[1] - lo[2] <= NEAR_TEXT
        if z >= STRONG or near:
            kept.append((i, j, z))
    if not kept:
        return 0.0
    covered, pi, pj = 0.0, None, None
    for i, j, z in kept:
        if pi is None:
            head = item[:i]
            covered += _gap(head, text[max(0, j - len(head) - len(head) // 4 - 1) : j])
        elif i > pi and j > pj:
            covered += _gap(item[pi:i], text[pj:j])
        covered += z - (max(0, pi - i, pj - j) if pi is not None else 0)
        pi, pj = i + z, j + z
    tail = item[pi:]
    covered += _gap(tail, text[pj : pj + len(tail) + len(tail) // 4 + 1])
    return min(1.0, covered / len(item))
