"""A structural index over a batch of JSON texts, built with whole-array operations.

Quote, bracket and delimiter positions are found for all texts of a batch at once; the parity of
quotes tells what lies inside strings, prefix sums over brackets give the nesting depth, and a
token's place among those of its container tells keys from values and malformed from well-formed
JSON.  No text is parsed value by value.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.functions.arrowtext import buffers, span_hashes

OBJECT, ARRAY, STRING, SCALAR = 0, 1, 2, 3

_CODE = np.zeros(256, np.uint8)
for _n, _c in enumerate(b"{}[]:,", 1):
    _CODE[_c] = _n
_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA, _STR, _SCA = range(1, 9)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_KIND = np.full(9, -1, np.int8)
_KIND[[_OPEN_O, _OPEN_A, _STR, _SCA]] = [OBJECT, ARRAY, STRING, SCALAR]
_VALUE = _KIND >= 0
#: A number or literal of JSON, from its first to its last byte (RE2 syntax).
PLAIN = r"\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\z"


def key_hash(name: str) -> np.uint64:
    """The hash that a member's key has if its text is ``name``."""
    data = np.frombuffer(name.encode(), np.uint8)
    return span_hashes(data, np.array([0]), np.array([len(data)]))[0] if len(data) else np.uint64(0)


class Index:
    """Values of many JSON texts.  A value's number is that of its first token.

    kind, parent (-1 for a root), place (0-based in its container), key (hash of its name in an
    object, else 0), begin and end (bytes), row, level (0 for a root); root has each text's
    root value, or -1 if the text is not one well-formed JSON value.
    """

    @staticmethod
    def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which spans are numbers or literals of JSON."""
        sizes = ends - starts
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        raw = data[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)]
        spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(raw.tobytes())])
        return pc.match_substring_regex(spans, pattern=PLAIN).to_numpy(zero_copy_only=False).astype(bool)

    def __init__(self, texts: pa.Array):
        data, offs = buffers(texts)
        self.data, self.raw = data, data.tobytes()
        rows = len(offs) - 1
        self.root = np.full(rows, -1, np.int64)
        bad = np.zeros(rows, bool)
        row_of = lambda at: np.searchsorted(offs, at, side="right") - 1

        quotes = np.flatnonzero(data == 34)
        slashes = np.flatnonzero(data == 92)
        if len(slashes):
            head = np.append(True, np.diff(slashes) != 1)
            head |= np.isin(slashes, offs[:-1])
            first = slashes[np.flatnonzero(head)][np.cumsum(head) - 1]
            acting = slashes[(slashes - first) % 2 == 0]  # each escapes the byte after it
            last = acting + 1 == offs[row_of(acting) + 1]
            bad[row_of(acting[last])] = True
            acting = acting[~last]
            quotes = quotes[~np.isin(quotes - 1, acting, assume_unique=True)]
            after = acting + 1
            wrong = ~_ESCAPED[data[after]]
            u = after[data[after] == ord("u")]
            if len(u):
                four = np.minimum(u[:, None] + np.arange(1, 5), len(data) - 1)
                short = ~_HEX[data[four]].all(axis=1) | (u + 4 >= len(data))
                bad[row_of(u[short])] = True
            bad[row_of(acting[wrong])] = True
        qrow = row_of(quotes)
        firstq = np.searchsorted(qrow, np.arange(rows))
        odd = np.bincount(qrow, minlength=rows) % 2 == 1
        bad |= odd
        opening = (np.arange(len(quotes)) - firstq[qrow]) % 2 == 0
        inside = np.zeros(len(data) + 1, np.int8)
        inside[quotes[opening]] = 1
        closes = quotes[~opening] + 1
        inside[closes] -= 1
        lone = np.flatnonzero(odd)
        if len(lone):  # a string that never closes ends with its text
            inside[offs[lone + 1]] -= 1
        within = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        bad_control = np.flatnonzero(within & (data < 32))
        bad[row_of(bad_control)] = True

        outside = ~within
        code = _CODE[data]
        structural = np.flatnonzero(outside & (code > 0))
        loose = outside & (code == 0) & ~_SPACE[data]
        start = loose.copy()
        start[1:] &= ~loose[:-1]
        heads = offs[:-1][offs[:-1] < len(data)]
        start[heads] = loose[heads]
        scalars = np.flatnonzero(start)
        stop = loose.copy()
        stop[:-1] &= ~loose[1:] | start[1:]
        scalar_ends = np.flatnonzero(stop) + 1
        pairs = np.flatnonzero(opening)
        pairs = pairs[(pairs + 1 < len(quotes))]
        pairs = pairs[~opening[pairs + 1]]
        strings, string_ends = quotes[pairs], quotes[pairs + 1] + 1

        at = np.concatenate([structural, strings, scalars])
        kind = np.concatenate([code[structural], np.full(len(strings), _STR, np.uint8), np.full(len(scalars), _SCA, np.uint8)])
        ends = np.concatenate([structural + 1, string_ends, scalar_ends])
        order = np.argsort(at, kind="stable")
        at, kind, ends = at[order], kind[order], ends[order]
        row = row_of(at)
        n = len(at)
        scalar = kind == _SCA
        bad[row[scalar][~self._plain(data, at[scalar], ends[scalar])]] = True

        step = np.zeros(n, np.int64)
        opens = (kind == _OPEN_O) | (kind == _OPEN_A)
        shuts = (kind == _CLOSE_O) | (kind == _CLOSE_A)
        step[opens], step[shuts] = 1, -1
        total = np.cumsum(step)
        firstt = np.searchsorted(row, np.arange(rows + 1))
        base = np.concatenate([[0], total])[firstt[:-1]]
        after_ = total - base[row]
        level = np.where(opens, after_ - 1, after_)
        np.logical_or.at(bad, row[after_ < 0], True)
        lastt = firstt[1:] - 1
        some = firstt[1:] > firstt[:-1]
        bad[some] |= after_[lastt[some]] != 0
        bad |= ~some

        good = ~bad[row]
        self.parent = np.full(n, -2, np.int64)
        self.place = np.zeros(n, np.int64)
        self.key = np.zeros(n, np.uint64)
        self.key_at = np.full(n, -1, np.int64)
        self.end = ends.copy()
        level[~good] = -1
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(0, (int(level.max()) if n else -1) + 2))
        upper = np.zeros(0, np.int64)
        names, named = [], []
        for lv in range(len(bounds) - 1):
            own = by_level[bounds[lv] : bounds[lv + 1]]  # in order of position
            shut = own[shuts[own]]
            here = own[~shuts[own]]
            if lv == 0:
                parent = np.full(len(here), -1, np.int64)
                group = row[here]
            else:
                parent = upper[np.searchsorted(at[upper], at[here], side="right") - 1]
                group = parent
            head = np.append(True, group[1:] != group[:-1]) if len(here) else np.zeros(0, bool)
            ordinal = np.arange(len(here)) - np.flatnonzero(head)[np.cumsum(head) - 1] if len(here) else parent
            k = kind[here]
            value = _VALUE[k]
            if lv == 0:
                ok = (ordinal == 0) & value
                isval, place = ok, ordinal
            else:
                in_object = kind[parent] == _OPEN_O
                part = np.where(in_object, ordinal % 4, ordinal % 2)
                want = np.where(in_object, part == 2, part == 0)
                ok = np.where(want, value, np.where(in_object, np.where(part == 0, k == _STR, np.where(part == 1, k == _COLON, k == _COMMA)), k == _COMMA))
                isval, place = want & value, np.where(in_object, ordinal // 4, ordinal // 2)
                if len(here):
                    tail = np.append(head[1:], True)
                    full = np.where(in_object, part == 2, part == 0)
                    ok &= ~tail | full
            bad[row[here[~ok]]] = True
            self.parent[here[isval]] = parent[isval]
            self.place[here[isval]] = place[isval]
            if lv:
                member = np.flatnonzero(isval & in_object & (ordinal >= 2))
                names.append(here[member - 2])
                named.append(here[member])
            up = here[opens[here]]
            if len(up) == len(shut):  # else some row is bad already
                self.end[up] = ends[shut]
                wrong = kind[up] + 1 != kind[shut]
                bad[row[up[wrong]]] = True
            upper = up
        if names:
            key, val = np.concatenate(names), np.concatenate(named)
            order = np.argsort(at[key], kind="stable")
            key, val = key[order], val[order]
            lo, hi = at[key] + 1, ends[key] - 1
            full = hi > lo
            self.key[val[full]] = span_hashes(data, lo[full], hi[full])
            self.key_at[val] = key
            if len(slashes):  # keys written with escapes are few; they are named by what they mean
                first = np.searchsorted(slashes, lo)
                for x, v in zip(key[odd_ := first < np.searchsorted(slashes, hi)], val[odd_]):
                    if not bad[row[v]]:
                        self.key[v] = key_hash(json.loads(self.raw[at[x] : ends[x]]))
        self.begin, self.row, self.level = at, row, level
        self.kind = _KIND[kind]
        self.parent[bad[row]] = -2
        self.is_value = self.parent >= -1
        roots = np.flatnonzero(self.is_value & (level == 0))
        self.root[row[roots]] = roots
        self.ok = ~bad

    def _among(self, nodes: np.ndarray) -> np.ndarray:
        """For each value, which of ``nodes`` is its parent, else -1."""
        slot = np.full(len(self.kind) + 1, -1, np.int64)
        slot[nodes] = np.arange(len(nodes))
        parent = self.parent.copy()
        parent[parent < 0] = len(self.kind)
        return slot[parent]

    def members(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values directly inside ``nodes`` in text order, and for each the position of its container in ``nodes``."""
        slot = self._among(nodes)
        got = np.flatnonzero(slot >= 0)
        return got, slot[got]

    def get(self, nodes: np.ndarray, name: str) -> np.ndarray:
        """The value that each node has under ``name``, or -1; of repeated names the last."""
        out = np.full(len(nodes), -1, np.int64)
        if len(nodes):
            slot = self._among(nodes)
            got = np.flatnonzero((slot >= 0) & (self.key == key_hash(name)))
            out[slot[got]] = got
        return out

    def names(self, values: np.ndarray) -> list[str]:
        """The names of object members."""
        return [json.loads(self.raw[self.begin[k] : self.end[k]]) for k in self.key_at[values]]

    def null(self, values: np.ndarray) -> np.ndarray:
        """Which values are null (or -1, which is none)."""
        begin = self.begin[values]
        return (values < 0) | ((self.kind[values] == SCALAR) & (self.data[begin] == ord("n"))) if len(values) else np.zeros(0, bool)

    def text(self, values: np.ndarray) -> list[str | None]:
        """Strings as they read, other values as they are written, None for null and for -1."""
        raw, out = self.raw, []
        for v, b, e, k, none in zip(values, self.begin[values], self.end[values], self.kind[values], self.null(values)):
            if none:
                out.append(None)
            elif k == STRING:
                s = raw[b + 1 : e - 1]
                out.append(s.decode() if b"\\" not in s else json.loads(raw[b:e]))
            else:
                out.append(raw[b:e].decode())
        return out
