"""Merging many short strings at once by a table of ranked symbol pairs."""

from __future__ import annotations

import numpy as np

from .units import gathered

#: Symbols merged in one sweep; bounds the memory of the matrices.
SWEEP = 2_000_000


class PairTable:
    """Sorted (left, right) pairs with their rank (lower merges first) and the symbol they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, symbols: int):
        self.symbols = symbols
        keys = left.astype(np.int64) * symbols + right
        order = np.lexsort((rank, keys))
        keys, first = np.unique(keys[order], return_index=True)
        self.keys, self.rank, self.made = keys, rank[order][first].astype(np.int64), made[order][first].astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or the largest integer) and made symbol of each pair."""
        keys = left.astype(np.int64) * self.symbols + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NEVER), self.made[at]


NEVER = np.iinfo(np.int64).max


def _agenda(rows: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row to the end: each turn takes the best-ranked, then leftmost, pair of each row's agenda.

    rows (n, width) holds symbols, those past the length are ignored. The
    agenda of a row is the vector of its adjacent pairs' ranks; a merge
    rewrites the merged pair's two neighbours and drops one entry.
    """
    rows, lengths = rows.copy(), lengths.copy()
    n, width = rows.shape
    rank = np.full((n, width), NEVER)
    made = np.zeros((n, width), np.int64)
    if width > 1:
        rank[:, :-1], made[:, :-1] = table.find(rows[:, :-1], rows[:, 1:])
        rank[np.arange(width)[None, :] >= lengths[:, None] - 1] = NEVER
    live = np.flatnonzero(rank.min(1) < NEVER) if n else np.zeros(0, int)
    columns = np.arange(width)
    while len(live):
        best = rank[live].argmin(1)
        rows[live, best] = made[live, best]
        # close the gap: everything right of the merged pair moves one place
        take = np.minimum(columns[None, :] + (columns[None, :] > best[:, None]), width - 1)
        rows[live] = np.take_along_axis(rows[live], take, 1)
        move = np.minimum(columns[None, :] + (columns[None, :] >= best[:, None] + 1), width - 1)
        rank[live] = np.take_along_axis(rank[live], move, 1)
        made[live] = np.take_along_axis(made[live], move, 1)
        lengths[live] -= 1
        size = lengths[live]
        for shift in (-1, 0):
            place = best + shift
            ok = (place >= 0) & (place + 1 < size)
            r, p = live[ok], place[ok]
            rank[r, p], made[r, p] = table.find(rows[r, p], rows[r, p + 1])
        over = best >= size - 1
        rank[live[over], best[over]] = NEVER
        rank[live, np.minimum(size, width - 1)] = NEVER
        live = live[rank[live].min(1) < NEVER]
    return rows, lengths


def _agenda_long(row: np.ndarray, table: PairTable) -> np.ndarray:
    """The same for one long row: a heap holds its agenda and links its symbols, in n log n steps."""
    import heapq

    n = len(row)
    symbol, after, before = row.astype(np.int64).tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    rank, made = (x.tolist() for x in table.find(row[:-1], row[1:]))
    heap = [(r, i, symbol[i], symbol[i + 1], m) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r < NEVER]
    heapq.heapify(heap)
    gone = [False] * n
    known: dict = {}

    def push(i: int) -> None:
        j = after[i]
        if i < 0 or j >= n:
            return
        pair = (symbol[i], symbol[j])
        if pair not in known:
            r, m = table.find(np.array([pair[0]]), np.array([pair[1]]))
            known[pair] = int(r[0]), int(m[0])
        r, m = known[pair]
        if r < NEVER:
            heapq.heappush(heap, (r, i, *pair, m))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i] if not gone[i] else n
        if j >= n or symbol[i] != a or symbol[j] != b:
            continue
        symbol[i], after[i], gone[j] = m, after[j], True
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    return np.array([s for s, g in zip(symbol, gone, strict=True) if not g], np.int64)


#: Width from which a row is merged by the heap, not in the matrix.
LONG = 64


def merge_all(flat: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge strings laid end to end: their symbols afterwards, again end to end, and the new lengths. Strings of like length share a matrix."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    after = lengths.copy()
    out = flat.copy()  # a merged string never outgrows its place
    i = int(np.searchsorted(ranked, 2))
    while i < len(order):
        width = int(ranked[i])
        if width > LONG:
            k = order[i]
            done = _agenda_long(flat[starts[k] : starts[k] + width], table)
            out[starts[k] : starts[k] + len(done)], after[k] = done, len(done)
            i += 1
            continue
        width += 2 if width > 4 else 0
        j = min(int(np.searchsorted(ranked, min(width, LONG), "right")), i + max(1, SWEEP // width))
        part, size = order[i:j], ranked[i:j]
        inside = np.arange(width)[None, :] < size[:, None]
        rows = np.zeros((len(part), width), np.int64)
        rows[inside] = gathered(flat, starts[part], size)
        done, left = _agenda(rows, size, table)
        begin = np.cumsum(left) - left
        out[np.arange(int(left.sum())) + np.repeat(starts[part] - begin, left)] = done[np.arange(width)[None, :] < left[:, None]]
        after[part] = left
        i = j
    return gathered(out, starts, after), after
