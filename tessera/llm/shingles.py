"""Word shingles of whole texts as 128-bit numbers, in numpy."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .units import SWEEP, Units, sweeps

WORDS = 5
#: Words of a shingle are told apart by 128-bit digests; a set of shingles is named by one.
DIGEST = 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising step of a 64-bit mixer: every input bit reaches every output bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd factors of the places in a shingle, one row for each half of a word's digest.
_PLACE = mix(np.arange(1, 2 * WORDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)).reshape(2, WORDS) | np.uint64(1)


def _totals(words: np.ndarray, size: int) -> np.ndarray:
    """128 bits, as two rows, for each run of ``size`` words, from both halves of their digests."""
    n = len(words) - size + 1
    total = np.full((2, n), size, np.uint64)
    for k in range(size):
        left, right = words[k : k + n].T
        # one half enters through a mixer, so no sum is linear in the digests
        total[0] += left * _PLACE[0, k] + mix(right + _PLACE[1, k])
        total[1] += right * _PLACE[1, k] + mix(left + _PLACE[0, k])
    return mix(total)


def _distinct(shingles: np.ndarray) -> np.ndarray:
    """The shingles once each, sorted; those that share their first half are told apart by their second."""
    sort = shingles[:, np.argsort(shingles[0], kind="stable")]
    same = sort[0, 1:] == sort[0, :-1]
    if (sort[1, 1:][same] != sort[1, :-1][same]).any():
        sort = shingles[:, np.lexsort((shingles[1], shingles[0]))]
        same = (sort[:, 1:] == sort[:, :-1]).all(0)
    return sort[:, np.r_[True, ~same]]


def _sets(texts: list[str], units: Units) -> list[np.ndarray]:
    """shingle_sets of the texts of one sweep. Each distinct word is digested once."""
    coded = [t.encode("utf-8", "replace").lower() for t in texts]
    joined = b"\n".join(coded) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros((2, 0), np.uint64) for _ in texts]
    first, kind = units.distinct(data, starts, ends)
    digests = b"".join([hashlib.blake2b(joined[x:y], digest_size=DIGEST).digest() for x, y in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
    words = np.frombuffer(digests, np.uint64).reshape(-1, 2)[kind]
    runs = _totals(words, WORDS) if len(words) >= WORDS else None
    stops = np.searchsorted(starts, np.cumsum([len(c) + 1 for c in coded])).tolist()
    out = []
    for x, y in zip([0, *stops], stops, strict=False):
        if y - x >= WORDS:
            out.append(_distinct(runs[:, x : y - WORDS + 1]))
        else:
            out.append(_totals(words[x:y], y - x) if y > x else np.zeros((2, 0), np.uint64))
    return out


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Distinct shingles of WORDS words of each text, 128 bits as two rows, sorted by the first; a shorter text is one shingle, an empty one has none."""
    units = _units()
    return [s for sweep in sweeps([t or "" for t in texts], SWEEP // 2) for s in _sets(sweep, units)]


@lru_cache(maxsize=1)
def _units() -> Units:
    return Units()


def shingle_set(text: str | None) -> np.ndarray:
    """The shingles of one text."""
    return shingle_sets([text])[0]


def set_digest(shingles: np.ndarray) -> bytes:
    """Name of a set of shingles."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=DIGEST).digest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Number of shingles that two sets share, all 128 bits compared."""
    if any((x[0, 1:] == x[0, :-1]).any() for x in (a, b)):
        return len(set(zip(*a.tolist(), strict=True)) & set(zip(*b.tolist(), strict=True)))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int((a[1][i] == b[1][j]).sum())
