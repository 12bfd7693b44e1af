"""Pre-tokenisation without regular expressions.

Finds where the pieces of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` begin.
Each code point becomes a class, each class (with a look at the next code points) a symbol, each symbol a
function on the eight states of a small automaton. These functions and their compositions form a small monoid, so a
prefix of the text is one element of it and prefixes combine associatively: blocks of text are composed side by side, the blocks' totals
are scanned, and all states follow from each block's entry state.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

L, N, O, S, SPACE, APOSTROPHE, BREAK = range(7)  # noqa: E741
_WHITE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# symbols: letters, numbers, others, a contraction of one or two letters, white space before white space or
# the end, the last white space before something else (other than U+0020, U+0020), the end of a text, padding
SYMBOLS = 10
_L, _N, _O, _A1, _A2, _W, _LAST, _LAST_SPACE, _END, _PAD = range(SYMBOLS)
# states: nothing open, in letters, in numbers, in others, in white space, after a space that joins what follows, before the last or the last two letters of a contraction
CLOSED, IN_L, IN_N, IN_O, IN_W, PENDING, C1, C2 = range(8)
_BLOCK = 128


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins here."""
    if symbol == _PAD:
        return state, False
    if symbol == _L and state in (C1, C2):
        return (CLOSED if state == C1 else C1), False
    if symbol in (_A1, _A2) and state not in (IN_O, PENDING):
        return (C1 if symbol == _A1 else C2), True
    if symbol in (_L, _N, _O, _A1, _A2):
        own = {_L: IN_L, _N: IN_N}.get(symbol, IN_O)
        return own, state not in (own, PENDING)
    if symbol == _W:
        return IN_W, state != IN_W
    return (PENDING if symbol == _LAST_SPACE else CLOSED), True


@lru_cache(1)
def _tables():
    """(next state, begins) by state and symbol; the monoid: elements by symbol, products, effect on each state."""
    steps = [[_step(s, x) for x in range(SYMBOLS)] for s in range(8)]
    after = np.array([[t[0] for t in row] for row in steps], dtype=np.uint8)
    begins = np.array([[t[1] for t in row] for row in steps], dtype=bool)
    generators = [tuple(int(v) for v in after[:, x]) for x in range(SYMBOLS)]
    elements: dict[tuple, int] = {}
    for g in generators:
        elements.setdefault(g, len(elements))
    todo = list(elements)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[v] for v in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    listed, k = list(elements), len(elements)
    product = np.array([[elements[tuple(g[v] for v in f)] for g in listed] for f in listed], dtype=np.uint16).reshape(-1)
    return after, begins, np.array([elements[g] for g in generators], dtype=np.uint16), product, k, np.array(listed, dtype=np.uint8), elements[tuple(range(8))]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(sys.maxunicode + 1, O, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = L
        elif kind == "N":
            table[c] = N
    table[list(_WHITE)] = S
    table[0x20], table[0x27] = SPACE, APOSTROPHE
    return table


def _symbols(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Symbols of a stretch; the last position sees the end of a text."""
    first = np.array([_L, _N, _O, _W, _W, _O, _END], dtype=np.uint8)
    out = first[kind]
    white = (kind == S) | (kind == SPACE)
    solid = ~white & (kind != BREAK)
    last = np.zeros(len(kind), dtype=bool)
    last[:-1] = white[:-1] & solid[1:]
    out[last] = np.where(kind[last] == SPACE, _LAST_SPACE, _LAST)
    at = np.flatnonzero(kind == APOSTROPHE)
    if len(at):
        n = len(points)
        one = np.where(at + 1 < n, points[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        letter = {c: ord(c) for c in "stmdrevl"}
        short = np.isin(one, [letter[c] for c in "stmd"])
        long = ((two == letter["e"]) & np.isin(one, [letter["r"], letter["v"]])) | ((one == letter["l"]) & (two == letter["l"]))
        free = kind[np.minimum(at + 1, n - 1)] != BREAK
        free2 = free & (kind[np.minimum(at + 2, n - 1)] != BREAK)
        out[at[short & free]] = _A1
        out[at[long & free2]] = _A2
    return out


def boundaries(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Positions where pieces begin. ``kind`` is the class of each point, BREAK between texts (each BREAK is a piece of its own)."""
    after, begins, element, product, k, effect, identity = _tables()
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    symbol = _symbols(points, kind)
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, _PAD, dtype=np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)  # one row for each place in a block
    total = np.full(rows, identity, dtype=np.int64)
    for j in range(_BLOCK):
        total = product[total * k + element[columns[j]]].astype(np.int64)
    entry, state = np.empty(rows, dtype=np.uint8), CLOSED
    for r, f in enumerate(total.tolist()):
        entry[r] = state
        state = int(effect[f, state])
    after, begins = after.reshape(-1), begins.reshape(-1)
    found, state = np.empty((_BLOCK, rows), dtype=bool), entry.astype(np.int64)
    for j in range(_BLOCK):
        at = state * SYMBOLS + columns[j]
        found[j] = begins[at]
        state = after[at].astype(np.int64)
    return np.flatnonzero(found.T.reshape(-1)[:n])


#: Code points that are worked on at a time.
STRETCH = 1 << 20


def pieces(texts: list[str]):
    """For each text the list of its pieces, in order.

    Texts are joined with BREAK between them up to STRETCH code points, so that short texts share the scan. A longer
    text is worked through in stretches cut before a letter that follows white space, where every state but an open space is closed; the cut keeps the space.
    """
    table = classes()
    waiting: list[str] = []
    size = 0

    def flush():
        nonlocal waiting, size
        joined = "\n".join(waiting) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        kind = table[points]
        ends = np.cumsum([len(t) + 1 for t in waiting]) - 1
        kind[ends] = BREAK
        at = boundaries(points, kind)
        first = np.searchsorted(at, np.concatenate([[0], ends[:-1] + 1]))
        last = np.searchsorted(at, ends)
        bounds = at.tolist()
        for f, e in zip(first.tolist(), last.tolist()):
            yield [joined[a:b] for a, b in zip(bounds[f:e], bounds[f + 1 : e + 1])]
        waiting, size = [], 0

    for text in texts:
        if len(text) > STRETCH:
            if waiting:
                yield from flush()
            yield _long(text)
            continue
        if size + len(text) > STRETCH and waiting:
            yield from flush()
        waiting.append(text)
        size += len(text) + 1
    if waiting:
        yield from flush()


def _long(text: str) -> list[str]:
    """Pieces of one long text, STRETCH by STRETCH: what begins in the last stretch's final piece is carried over."""
    table, out, at = classes(), [], 0
    size = STRETCH
    while at < len(text):
        part = text[at : at + size]
        points = np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)
        bounds = boundaries(points, table[points]).tolist()
        if at + len(part) < len(text):
            # the last three boundaries may move once more text is seen: pieces before them stand
            bounds = bounds[:-3]
            if len(bounds) < 2:
                size *= 2
                continue
            out += [part[a:b] for a, b in zip(bounds, bounds[1:])]
            at += bounds[-1]
        else:
            out += [part[a:b] for a, b in zip(bounds, [*bounds[1:], len(part)])]
            at += len(part)
        size = STRETCH
    return out
