"""Equal pieces of a long text found once: distinct units of a sweep, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are handled at once; bounds the memory of every array here.
SWEEP = 500_000
_STEP = 0xD1342543DE82EF95
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    held = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        held[done : done + step] = held[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return held[:n]


class Units:
    """Finder of distinct units. Powers are kept for one sweep's length, longer texts have their own."""

    def __init__(self) -> None:
        self.up, self.down = _powers(_STEP, SWEEP + 1), _powers(_BACK, SWEEP + 1)

    def distinct(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of one unit of each kind, and each unit's kind.

        Units points[start:end] are grouped by a rolling hash; every unit is
        then compared with its group's first one letter by letter, and units
        that differ are grouped by their letters, so the result is exact.
        """
        n = len(points)
        up, down = (self.up, self.down) if n < len(self.up) else (_powers(_STEP, n + 1), _powers(_BACK, n + 1))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        size = ends - starts
        keys = (sums[ends] - sums[starts]) * down[starts]
        keys ^= keys >> np.uint64(29)
        keys = keys * np.uint64(64) + np.minimum(size, 63).astype(np.uint64)
        _, first, kind = np.unique(keys, return_index=True, return_inverse=True)
        if len(starts) and not self._same(points, starts, size, first[kind]):
            seen: dict[bytes, int] = {}
            kind = np.array([seen.setdefault(points[a:b].tobytes(), len(seen)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            first = np.unique(kind, return_index=True)[1]
        return first, kind

    @staticmethod
    def _same(points: np.ndarray, starts: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
        """Whether every unit has its model's length and letters."""
        if not (size == size[like]).all():
            return False
        begin = np.cumsum(size) - size
        run = np.arange(int(size.sum()))
        return bool((points[run + np.repeat(starts - begin, size)] == points[run + np.repeat(starts[like] - begin, size)]).all())


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices flat[start:start + length] one after another."""
    begin = np.cumsum(lengths) - lengths
    return flat[np.arange(int(lengths.sum())) + np.repeat(starts - begin, lengths)]


def code_points(text: str) -> np.ndarray:
    """The text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sweeps(texts: list[str], size: int = SWEEP) -> Iterator[list[str]]:
    """Neighbouring texts of together at most ``size`` code points; a longer text comes alone."""
    held, total = [], 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def array_sweeps(texts: pa.Array, size: int = SWEEP) -> Iterator[list[str]]:
    """The texts of an Arrow array, null as empty, in sweeps: only one sweep exists as Python strings at a time."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > size:
            yield [t or "" for t in texts.slice(start, i - start).to_pylist()]
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield [t or "" for t in texts.slice(start).to_pylist()]


class Remembered:
    """Two generations of a mapping: what is met again outlives a change of generation, the rest is let go.

    At most 2 * ``most`` entries are held.
    """

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def known(self, keys: list) -> list:
        """Keys that are not remembered."""
        missing = []
        young, old = self.young, self.old
        for key in keys:
            if key not in young:
                found = old.get(key)
                if found is None:
                    missing.append(key)
                else:
                    young[key] = found
        return missing

    def turn(self) -> None:
        """Let go of what wasn't met since the last turn, once there is enough of it."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
