"""A run-length grammar of word sequences by recompression, and longest common extensions on it.

Levels alternate between block compression, which names each maximal run of one symbol, and pair compression, which names
each pair of neighbours whose first symbol is on the left and whose second is on the right of a split of the alphabet. Both
depend only on the symbols at hand, so equal stretches are parsed alike up to their margins, and two positions are compared
by climbing to names of ever longer stretches and coming down again at the first difference.

One grammar holds many sequences, each closed by a symbol of its own that never takes part, so no comparison leaves its
sequence. All queries of a call run together over NumPy arrays.
"""

from __future__ import annotations

import numpy as np

from colsight.llm.common import mix

BLOCKS, PAIRS = 0, 1

_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Level:
    """One string of the grammar and how its symbols are grouped into those of the next."""

    def __init__(self, symbols: np.ndarray, kind: int, starts: np.ndarray, spans: np.ndarray):
        self.symbols, self.kind, self.spans = symbols, kind, spans
        #: First position of each group, closed by the length; the group of each position.
        self.starts = np.append(starts, len(symbols))
        marks = np.zeros(len(symbols), np.int64)
        marks[starts] = 1
        self.group = np.cumsum(marks) - 1
        self.sizes = np.diff(self.starts)

    def mirrored(self) -> _Level:
        n = len(self.symbols)
        return _Level(self.symbols[::-1].copy(), self.kind, (n - self.starts[1:])[::-1].copy(), self.spans[::-1].copy())


def _renamed(first: np.ndarray, second: np.ndarray, fresh: int) -> np.ndarray:
    """A new name from ``fresh`` on for each distinct pair."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    names = np.empty(len(a), np.int64)
    names[order] = fresh + np.cumsum(new) - 1
    return names


def _block_starts(symbols: np.ndarray) -> np.ndarray:
    keep = np.ones(len(symbols), bool)
    keep[1:] = symbols[1:] != symbols[:-1]
    return np.flatnonzero(keep)


def _pair_starts(symbols: np.ndarray, closing: np.ndarray, depth: int) -> np.ndarray:
    """Where groups start when the alphabet is split by a bit of the symbols' hashes, the side with more pairs first."""
    side = (mix((symbols + 1).astype(np.uint64) * _ODD + np.uint64(depth)) & np.uint64(1)).astype(bool)
    inner = ~closing[:-1] & ~closing[1:]
    up, down = inner & ~side[:-1] & side[1:], inner & side[:-1] & ~side[1:]
    paired = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
    keep = np.ones(len(symbols), bool)
    keep[1:] = ~paired
    return np.flatnonzero(keep)


class Grammar:
    """The grammar of all ``sequences`` of non-negative numbers, given behind each other with their ``lengths``."""

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray):
        sequences = len(lengths)
        ends = np.cumsum(lengths)
        at = np.arange(len(numbers)) + np.repeat(np.arange(sequences), lengths)
        symbols = np.empty(len(numbers) + sequences, np.int64)
        symbols[at] = numbers
        fresh = int(numbers.max(initial=-1)) + 1
        closers = ends + np.arange(sequences)
        symbols[closers] = fresh + np.arange(sequences)
        fresh += sequences
        #: Where each sequence starts in the joined string.
        self.begins = closers - lengths
        self.levels: list[_Level] = []
        closing = np.zeros(len(symbols), bool)
        closing[closers] = True
        spans, depth = np.ones(len(symbols), np.int64), 0
        lone = np.count_nonzero(lengths)
        while len(symbols) - sequences > lone:
            for kind in (BLOCKS, PAIRS):
                starts = _block_starts(symbols) if kind == BLOCKS else _pair_starts(symbols, closing, depth)
                if len(starts) == len(symbols):
                    continue
                level = _Level(symbols, kind, starts, spans)
                self.levels.append(level)
                grown = np.flatnonzero(level.sizes > 1)
                heads = starts[grown]
                names = symbols[starts]
                # A name of a block never meets a name of a pair: each level takes fresh numbers.
                second = level.sizes[grown] if kind == BLOCKS else symbols[heads + 1]
                names[grown] = _renamed(symbols[heads], second, fresh)
                fresh += len(grown)
                spans = np.add.reduceat(spans, starts)
                closing = closing[starts]
                symbols = names
            depth += 1
        top = _Level(symbols, BLOCKS, np.arange(len(symbols)), spans)
        self.levels.append(top)
        self._mirror: list[_Level] | None = None
        self.size = len(self.levels[0].symbols)

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For positions x < y of one sequence, how many symbols from them on are equal."""
        return _extensions(self.levels, x, y)

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For positions x < y of one sequence, how many symbols just before them are equal."""
        if self._mirror is None:
            self._mirror = [level.mirrored() for level in self.levels]
        return _extensions(self._mirror, self.size - y, self.size - x)


def _extensions(levels: list[_Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common extensions of x < y, by climbing while names agree and descending at the first difference."""
    n = len(x)
    total = np.zeros(n, np.int64)
    # Queries that stopped climbing, by level: their numbers and positions there.
    stopped: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who, x, y = np.arange(n), x.astype(np.int64), y.astype(np.int64)
    for depth, level in enumerate(levels):
        symbols, group, starts, size = level.symbols, level.group, level.starts, len(level.symbols)
        last = depth == len(levels) - 1
        # A position at the end of the string has nothing left; y is the larger one.
        open_ = y < size
        same = np.zeros(len(who), bool)
        same[open_] = symbols[x[open_]] == symbols[y[open_]]
        gone = ~same if not last else np.ones(len(who), bool)
        stopped.append((who[gone], x[gone], y[gone]))
        if last:
            break
        who, x, y = who[same], x[same], y[same]
        gx, gy = group[x], group[y]
        rough = np.flatnonzero((starts[gx] != x) | (starts[gy] != y))
        climbs = np.ones(len(who), bool)
        if len(rough):
            rx, ry = x[rough], y[rough]
            left_x, left_y = starts[gx[rough] + 1] - rx, starts[gy[rough] + 1] - ry
            if level.kind == BLOCKS:
                step = np.minimum(left_x, left_y)
                total[who[rough]] += step * level.spans[rx]
                rx, ry = rx + step, ry + step
                climbs[rough] = left_x == left_y
            else:
                total[who[rough]] += level.spans[rx]
                rx, ry = rx + 1, ry + 1
                in_x, in_y = left_x == 2, left_y == 2
                both = np.flatnonzero(in_x & in_y)
                agree = both[symbols[rx[both]] == symbols[ry[both]]]
                total[who[rough[agree]]] += level.spans[rx[agree]]
                aligned = ~in_x & ~in_y
                rx[agree] += 1
                ry[agree] += 1
                aligned[agree] = True
                climbs[rough] = aligned
            x[rough], y[rough] = rx, ry
        rest = ~climbs
        if rest.any():
            a, b, c = stopped[-1]
            stopped[-1] = (np.append(a, who[rest]), np.append(b, x[rest]), np.append(c, y[rest]))
        who, x, y = who[climbs], x[climbs], y[climbs]
        x, y = group[x], group[np.minimum(y, size - 1)] + (y >= size)
    # Down again. Symbols that differ have parts that differ from the first on, or right behind an equal first part.
    who = x = y = np.zeros(0, np.int64)
    for level, (new, new_x, new_y) in zip(levels[::-1], stopped[::-1], strict=True):
        x, y = level.starts[x], level.starts[y]
        open_ = np.flatnonzero(y < len(level.symbols))
        open_ = open_[level.symbols[x[open_]] == level.symbols[y[open_]]]
        step = np.ones(len(open_), np.int64)
        if level.kind == BLOCKS:
            step = np.minimum(level.sizes[level.group[x[open_]]], level.sizes[level.group[y[open_]]])
        total[who[open_]] += step * level.spans[x[open_]]
        x[open_] += step
        y[open_] += step
        who, x, y = np.concatenate([who, new]), np.concatenate([x, new_x]), np.concatenate([y, new_y])
    return total
