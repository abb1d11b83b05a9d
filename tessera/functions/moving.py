"""Moving aggregates for the factor library: numpy over the sorted rows of a task, a batch and the rows just before it at a time.

A frame is the last n rows of a security. Aggregates run through it from its
oldest row with Spark's own update rules, so that constant frames have a
deviation of exactly zero. They are null unless the frame has n rows and none
of them is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _sum(frame, n):
    total = 0.0
    for x, in frame:
        total = total + x
    return total


def _moments(frame, third=False):
    mean = m2 = m3 = 0.0
    for k, (x,) in enumerate(frame, 1):
        delta = x - mean
        step = delta / k
        mean = mean + step
        m2 = m2 + delta * (delta - step)
        if third:
            m3 = m3 - 3.0 * step * m2 + delta * (delta * delta - step * step)
    return m2, m3


def _skew(frame, n):
    m2, m3 = _moments(frame, True)
    return np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2)


def _joint(frame):
    mx = my = ck = xx = yy = 0.0
    for k, (x, y) in enumerate(frame, 1):
        dx, dy = x - mx, y - my
        mx, my = mx + dx / k, my + dy / k
        ck = ck + dx * (y - my)
        xx, yy = xx + dx * (x - mx), yy + dy * (y - my)
    return mx, my, ck, xx, yy


def _intercept(frame, n):
    mx, my, ck, xx, _ = _joint(frame)
    return my - ck / xx * mx


def _slope(frame, n):
    _, _, ck, xx, _ = _joint(frame)
    return ck / xx


def _r2(frame, n):
    _, _, ck, xx, yy = _joint(frame)
    return ck * ck / xx / yy


def _extreme(pick):
    def run(frame, n):
        best = None
        for x, in frame:
            best = x if best is None else pick(best, x)
        return best

    return run


def _low_tail(frame, n):
    values = np.sort(np.stack([x for x, in frame]), axis=0)
    at = 0.05 * (n - 1)
    low = int(at)
    a, b = values[low], values[min(low + 1, n - 1)]
    return np.where(a == b, a, (low + 1 - at) * a + (at - low) * b)


def _drawdown(frame, n):
    peak = worst = None
    for x, in frame:
        peak = x if peak is None else np.maximum(peak, x)
        away = np.where(peak == 0, np.nan, x / peak - 1)
        worst = away if worst is None else np.fmin(worst, away)
    return worst


def _place(frame, n):
    rows = [x for x, in frame]
    below, same = sum((x < rows[-1]).astype(float) for x in rows), sum((x == rows[-1]).astype(float) for x in rows)
    return (below + (same + 1) / 2.0 - 1) / (n - 1)


KINDS = {
    "sum": _sum, "avg": lambda f, n: _sum(f, n) / n, "min": _extreme(np.fmin), "max": _extreme(np.maximum), "std": lambda f, n: np.sqrt(_moments(f)[0] / (n - 1)), "skew": _skew,
    "covar": lambda f, n: _joint(f)[2] / (n - 1), "slope": _slope, "intercept": _intercept, "r2": _r2, "low_tail": _low_tail, "drawdown": _drawdown, "place": _place,
}


def batches(wanted: list[tuple[str, int, tuple[str, ...]]], inputs: list[str], names: list[str]):
    """For mapInArrow over rows sorted by security and date: each batch without the inputs, with the wanted (kind, rows, inputs) as columns.

    Column ``_i`` numbers a security's rows from 1; the rows before a batch
    that its frames reach, 59 for the longest, are held from batch to batch.
    """
    reach = max(n for _, n, _ in wanted) - 1

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: (np.full(reach, np.nan), np.zeros(reach, bool)) for c in inputs}
        for batch in source:
            rows, place = batch.num_rows, batch.column("_i").to_numpy(zero_copy_only=False)
            if not rows:
                continue
            now = {}
            for c in inputs:
                x = batch.column(c)
                now[c] = (np.concatenate([held[c][0], x.to_numpy(zero_copy_only=False)]), np.concatenate([held[c][1], x.is_valid().to_numpy(zero_copy_only=False)]))
            held = {c: (x[len(x) - reach:], there[len(there) - reach:]) for c, (x, there) in now.items()}
            sums = {c: np.concatenate([[0], np.cumsum(there)]) for c, (_, there) in now.items()}
            made = []
            with np.errstate(all="ignore"):
                for kind, n, own in wanted:
                    whole = place >= n
                    for c in own:
                        whole &= sums[c][reach + 1:] - sums[c][reach + 1 - n : reach + 1 - n + rows] == n
                    frame = (tuple(now[c][0][reach - back : reach - back + rows] for c in own) for back in range(n - 1, -1, -1))
                    value = KINDS[kind](frame, n)
                    if kind == "drawdown":
                        whole &= ~np.isnan(value)
                    made.append(pa.array(value, pa.float64(), mask=~whole))
            kept = [c for c in batch.schema.names if c not in now]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + made, names=kept + names)

    return run
