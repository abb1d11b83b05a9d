"""Runs of repeated words by Crochemore's partition refinement, for all texts of a sweep at once in numpy.

Positions are held in classes of equal factors; a class is refined from one
factor length to the next by the classes of the following position, of which
only the smaller ones are walked. Neighbours in a class whose distance is the
length are squares of a primitive root, and squares that start at neighbouring
positions are one run.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run is reported from so many periods and so many words on.
PERIODS, WORDS = 4, 6
#: A run of PERIODS periods has at least so many equal factors of each length up to its period, so smaller classes are let go.
FEWEST = PERIODS - 1
#: Code points whose words are handled at once; a longer text comes alone. Bounds the memory of a worker.
SWEEP = 2_000_000
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every start, ``count`` of each, one after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Classes:
    """Classes of positions with equal factors of one length.

    A class is an interval of ``members`` (in any order) and a linked list by
    position; both are changed only where a position leaves its class.
    """

    def __init__(self, keys: np.ndarray, limit: np.ndarray):
        total = len(keys)
        self.members = np.argsort(keys, kind="stable")
        ordered = keys[self.members]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if total else np.zeros(0, np.int64)
        n = len(first)
        self.n = n
        self.slot = np.empty(total, np.int64)
        self.slot[self.members] = np.arange(total)
        # no class is ever joined, so there are at most as many as positions
        self.start, self.size, self.limit, self.live = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64), np.zeros(total + 1, bool)
        self.start[:n], self.size[:n], self.limit[:n] = first, np.diff(np.r_[first, total]), limit[self.members[first]]
        self.live[:n] = self.size[:n] >= FEWEST
        self.of = np.empty(total, np.int64)
        self.of[self.members] = np.repeat(np.arange(n), self.size[:n])
        self.next, self.before, self.gap = np.full(total, -1, np.int64), np.full(total, -1, np.int64), np.zeros(total, np.int64)
        self.marked = np.zeros(total, bool)
        self._link(self.members, self.of[self.members])
        self.gap[~self.live[self.of]] = 0

    def _link(self, positions: np.ndarray, group: np.ndarray) -> None:
        """Make a list of each group of ascending positions."""
        same = group[1:] == group[:-1]
        a, b = positions[:-1][same], positions[1:][same]
        self.next[positions], self.before[positions], self.gap[positions] = -1, -1, 0
        self.next[a], self.before[b], self.gap[a] = b, a, b - a

    def _unlink(self, positions: np.ndarray) -> None:
        """Take positions, sorted by class and place, out of their lists: whole stretches at once."""
        chain = np.r_[True, self.next[positions[:-1]] != positions[1:]]
        a, b = self.before[positions[chain]], self.next[positions[np.r_[chain[1:], True]]]
        self.next[a[a >= 0]] = b[a >= 0]
        self.before[b[b >= 0]] = a[b >= 0]
        both = (a >= 0) & (b >= 0)
        self.gap[a[a >= 0]] = 0
        self.gap[a[both]] = b[both] - a[both]

    def refine(self, walked: np.ndarray, length: int) -> np.ndarray:
        """Go from factors of ``length`` to those one longer; gives the positions to walk next.

        ``walked`` are the members of the classes that the last step made, but
        for one child of each class that it split: the largest.
        """
        before = walked[walked > 0] - 1
        splitter = self.of[before + 1]
        own = self.of[before]
        use = self.live[own] & (self.limit[own] > length)
        before, splitter, own = before[use], splitter[use], own[use]
        if not len(before):
            return before
        order = np.lexsort((before, splitter, own))
        before, splitter, own = before[order], splitter[order], own[order]
        fresh = np.r_[True, (own[1:] != own[:-1]) | (splitter[1:] != splitter[:-1])]
        at = np.flatnonzero(fresh)
        group, group_size = own[at], np.diff(np.r_[at, len(own)])
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        split, per_class = group[head], np.diff(np.r_[head, len(group)])
        rest = self.size[split] - np.add.reduceat(group_size, head)
        most = np.maximum.reduceat(group_size, head)
        # the first of each class's largest groups
        is_most = np.flatnonzero(group_size == np.repeat(most, per_class))
        largest = is_most[np.r_[True, group[is_most][1:] != group[is_most][:-1]]]
        # a class that loses all its members keeps its largest group instead
        moves = np.ones(len(group), bool)
        moves[largest[rest == 0]] = False
        stay_size = np.where(rest == 0, most, rest)
        touched = np.add.reduceat(moves.astype(np.int64), head) > 0
        if not touched.any():
            return before[:0]
        each = np.repeat(moves, group_size)
        moved, left = before[each], own[each]
        self._unlink(moved[np.lexsort((moved, left))])
        sizes, count = group_size[moves], int(moves.sum())
        new = np.arange(self.n, self.n + count)
        self.n += count
        label = np.repeat(new, sizes)
        self._link(moved, label)
        self._relocate(moved, left, split[touched], stay_size[touched])
        begin = np.cumsum(sizes) - sizes
        self.start[new], self.size[new], self.limit[new], self.live[new] = self.slot[moved[begin]], sizes, self.limit[group[moves]], sizes >= FEWEST
        self.of[moved] = label
        changed, stays = split[touched], stay_size[touched]
        self.size[changed], self.live[changed] = stays, stays >= FEWEST
        gone = changed[stays < FEWEST]
        self.gap[self.members[_spread(self.start[gone], self.size[gone])]] = 0
        self.gap[moved[~self.live[label]]] = 0
        # walk all children of a class but its largest
        over = (rest > 0) & (most > rest)
        skipped = np.zeros(len(group), bool)
        skipped[largest[over]] = True
        walk = moved[~np.repeat(skipped[moves], sizes)]
        kept = split[over]
        return np.r_[walk, self.members[_spread(self.start[kept], self.size[kept])]]

    def _relocate(self, moved: np.ndarray, left: np.ndarray, changed: np.ndarray, stays: np.ndarray) -> None:
        """Bring the moved members of each class to the end of its interval, in their order."""
        border = self.start[changed] + stays
        tail = _spread(border, self.size[changed] - stays)
        self.marked[moved] = True
        holes = self.slot[moved]
        holes = holes[holes < border[np.searchsorted(changed, left)]]
        stayers = self.members[tail]
        stayers = stayers[~self.marked[stayers]]
        self.marked[moved] = False
        self.members[holes], self.slot[stayers] = stayers, holes
        self.members[tail], self.slot[moved] = moved, tail


def find_runs(words: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """(text, start, length, period) of every run, four arrays sorted by text, start and period.

    ``words`` holds the numbers of the words of all texts one after another,
    ``counts`` how many words each text has. Words are compared within their
    text alone. A run is maximal, has its smallest period q, at least
    PERIODS * q and at least WORDS words.
    """
    texts = np.flatnonzero(counts >= WORDS)
    if not len(texts):
        return [np.zeros(0, np.int64)] * 4
    from_ = np.cumsum(counts) - counts
    n = counts[texts]
    # every text is followed by a place of its own that equals nothing: no factor goes beyond a text
    text = np.repeat(np.arange(len(texts)), n + 1)
    first = np.cumsum(n + 1) - n - 1
    stop = first + n
    letters = np.full(len(text), -1, np.int64)
    inside = np.ones(len(text), bool)
    inside[stop] = False
    letters[inside] = words[_spread(from_[texts], n)]
    limit = (n // PERIODS)[text]
    classes = _Classes(text * (int(letters.max()) + 2) + letters + 1, limit)
    alive, found = np.flatnonzero(classes.live[classes.of]), []
    near, walked = alive, np.arange(len(text))
    for length in range(1, int(limit.max()) + 1):
        if length & (length - 1) == 0:
            # distances in a class only grow: what is beyond twice the length now is looked at later
            alive = alive[classes.live[classes.of[alive]] & (limit[alive] >= length)]
            near = alive[classes.gap[alive] < 2 * length]
        squares = near[classes.gap[near] == length]
        squares = squares[limit[squares] >= length]
        if len(squares):
            cut = np.flatnonzero(np.r_[True, squares[1:] != squares[:-1] + 1])
            spans = np.diff(np.r_[cut, len(squares)]) - 1 + 2 * length
            long = spans >= max(WORDS, PERIODS * length)
            at = squares[cut[long]]
            found.append(np.array([texts[text[at]], at - first[text[at]], spans[long], np.full(len(at), length)]))
        walked = classes.refine(walked, length)
        if not len(walked):
            break
    if not found:
        return [np.zeros(0, np.int64)] * 4
    runs = np.concatenate(found, axis=1)
    return list(runs[:, np.lexsort((runs[3], runs[1], runs[0]))])


def planted_tail(words: list[bytes], code: int) -> list[bytes]:
    """The words with their tail made periodic, as the number asks: where it ends in 0, every word from a = g % n on, with g = code // 10, is taken p = 1 + (n - a) // (3 + g % 8) words apart from the first of them."""
    n, g = len(words), code // 10
    if code % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def _described(texts: list[str], codes: list[int | None]) -> Iterator[tuple]:
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    split = [w if c is None else planted_tail(w, c) for w, c in zip(split, codes, strict=True)]
    counts = np.array([len(w) for w in split], np.int64)
    names: dict[bytes, int] = {}
    for words in split:
        names.update(dict.fromkeys(words))
    for k, word in enumerate(names):
        names[word] = k
    numbers = np.fromiter((names[w] for words in split for w in words), np.int64, int(counts.sum()))
    text, start, length, period = find_runs(numbers, counts)
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    starts, lengths, periods = start.tolist(), length.tolist(), period.tolist()
    for words, x, y in zip(split, edges, edges[1:], strict=False):
        runs = list(zip(starts[x:y], lengths[x:y], periods[x:y], strict=True))
        if not runs:
            yield runs, None, b" ".join(words).decode("utf-8", "surrogatepass")
            continue
        strongest = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        keep = np.ones(len(words), bool)
        for s, n, q in runs:
            keep[s + q : s + n] = False
        yield runs, strongest, b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k]).decode("utf-8", "surrogatepass")


_ONE = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def run_column(text: Column, planted: Column | None = None) -> Column:
    """struct(runs, strongest, collapsed) of every whole text.

    ``runs`` are all runs by start and period, ``strongest`` the one with the
    greatest length / period (ties: smaller start, then smaller period; null
    without a run), ``collapsed`` the words outside any run's repeats (a run's
    first period stays), joined by one space. Words are separated by ASCII
    white space.

    ``planted`` gives a number for each text by which its tail is made periodic
    first (see ``planted_tail``); null leaves the text as it is.

    Nulls and texts without words have no runs and collapse to the empty text.
    Equal texts have equal results; a very long text is handled alone, whole.
    """

    @F.arrow_udf(f"runs {RUN}, strongest struct<start:bigint,length:bigint,period:bigint>, collapsed string")
    def describe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, codes in batches:
            held: list[tuple[list, list]] = [([], [])]
            total, made = 0, []
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
            for k, size in enumerate(sizes):
                if held[-1][0] and total + size > SWEEP:
                    made.extend(_described(*held.pop()))
                    held.append(([], []))
                    total = 0
                held[-1][0].append(texts[k].as_py() or "")
                held[-1][1].append(codes[k].as_py())
                total += size
            made.extend(_described(*held.pop()))
            row = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
            yield pa.StructArray.from_arrays(
                [
                    pa.array([[row(r) for r in runs] for runs, _, _ in made], pa.list_(_ONE)),
                    pa.array([row(best) if best else None for _, best, _ in made], _ONE),
                    pa.array([collapsed for _, _, collapsed in made], pa.string()),
                ],
                ["runs", "strongest", "collapsed"],
            )

    return describe(text, F.lit(None).cast("long") if planted is None else planted.cast("long"))
