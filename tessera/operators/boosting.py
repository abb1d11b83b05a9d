"""Gradient-boosted trees of many windows at once: every level of all windows' trees is one aggregation of histograms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import Folder

#: Gradients are summed as whole numbers of this part of a unit, so sums do not depend on how rows are dealt to tasks.
UNIT = 2**32
_BINNED = "trade_date date, symbol string, label double, bins binary"
_HISTOGRAM = pa.schema([("window_id", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("g", pa.int64()), ("n", pa.int64())])
_EPOCH = np.datetime64("1970-01-01")


@dataclass(frozen=True)
class Settings:
    """How trees are grown. A tree has at most ``leaves`` leaves in ``depth`` levels; of a level's leaves those with the greatest gain are split."""

    rounds: int = 10
    depth: int = 4
    leaves: int = 15
    rate: float = 0.1
    bins: int = 32
    least_rows: int = 20
    l2: float = 1.0
    patience: int = 3


@dataclass
class Tree:
    """Splits by node (children of i are 2i + 1 and 2i + 2): rows whose bin is at most ``at`` go left."""

    feature: np.ndarray
    at: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row falls into."""
        node = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            split = self.feature[node] >= 0
            if not split.any():
                return node
            r, k = rows[split], node[split]
            node[split] = 2 * k + 1 + (bins[r, self.feature[k]] > self.at[k])


@dataclass
class Ensemble:
    """The trees of one window, the mean label that they start from, and how many of them count."""

    window_id: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    best: int = 0
    errors: list[float] = field(default_factory=list)

    def score(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees[: self.best if trees is None else trees]:
            out += tree.value[tree.leaf_of(bins)]
        return out


def quantile_edges(rows: DataFrame, names: list[str], bins: int) -> np.ndarray:
    """Upper edges of the bins of each feature: one aggregate over all of them, one row to the driver."""
    shares = F.array(*(F.lit((k + 1) / bins) for k in range(bins - 1)))
    row = rows.agg(*(F.percentile_approx(n, shares, 10_000).alias(n) for n in names)).first()
    return np.array([np.maximum.accumulate(np.array(row[n] or [0.0] * (bins - 1), float)) for n in names])


def binned(rows: DataFrame, names: list[str], label: str, edges: np.ndarray) -> DataFrame:
    """trade_date, symbol, label and the features' bins, one byte each; a missing feature is in the first bin."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]) if b.num_rows else np.zeros((0, len(names)))
            out = np.column_stack([np.searchsorted(e, np.nan_to_num(x[:, k], nan=-np.inf), "left") for k, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column("trade_date"), b.column("symbol"), b.column("_label"), pa.array([r.tobytes() for r in out], pa.binary())], names=["trade_date", "symbol", "label", "bins"])

    plain = rows.select("trade_date", "symbol", F.col(label).cast("double").alias("_label"), *(F.col(n).cast("double").alias(n) for n in names))
    return plain.mapInArrow(code, _BINNED)


def _days(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int32()).to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _histograms(rows: DataFrame, spans: dict[int, tuple], models: dict[int, Ensemble], growing: dict[int, Tree], width: int, settings: Settings, errors: bool) -> DataFrame:
    """Sums of gradients and rows by (window, node, feature, bin) over all training rows; with ``errors``, squared errors of the validation rows as feature -1."""
    bins = settings.bins

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        wrong: dict[int, list[int]] = {}
        for b in batches:
            day, y, x = _days(b.column("trade_date")), b.column("label").to_numpy(zero_copy_only=False), _matrix(b.column("bins"), width)
            for w, (train, valid, _) in spans.items():
                own = np.flatnonzero((day >= train[0]) & (day <= train[1])) if w in growing else ()
                if len(own):
                    part = x[own]
                    g = np.rint((y[own] - models[w].score(part, len(models[w].trees))) * UNIT).astype(np.int64)
                    leaf = growing[w].leaf_of(part)
                    for node in np.unique(leaf).tolist():
                        if growing[w].gain[node] < 0:
                            continue
                        at = leaf == node
                        sums = held.setdefault((w, node), [np.zeros((width, bins), np.int64), np.zeros((width, bins), np.int64)])
                        place = (np.arange(width) * bins + part[at]).ravel()
                        sums[1] += np.bincount(place, minlength=width * bins).reshape(width, bins)
                        np.add.at(sums[0].reshape(-1), place, np.repeat(g[at], width))
                if errors:
                    other = np.flatnonzero((day >= valid[0]) & (day <= valid[1]))
                    if len(other):
                        miss = y[other] - models[w].score(x[other], len(models[w].trees))
                        total = wrong.setdefault(w, [0, 0])
                        total[0] += int(np.rint(miss * miss * UNIT).sum())
                        total[1] += len(other)
        out: list[list] = [[] for _ in _HISTOGRAM]
        for (w, node), (g, n) in held.items():
            feature, place = np.nonzero(n)
            for column, values in zip(out, ([w] * len(feature), [node] * len(feature), feature, place, g[feature, place], n[feature, place]), strict=True):
                column.extend(values)
        for w, (e, n) in wrong.items():
            for column, value in zip(out, (w, -1, -1, 0, e, n), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _HISTOGRAM, strict=True)], schema=_HISTOGRAM)

    parts = rows.mapInArrow(count, "window_id int, node int, feature int, bin int, g long, n long")
    return parts.groupBy("window_id", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def _best_splits(histograms: DataFrame, settings: Settings) -> DataFrame:
    """The best split of each (window, node), and its sums; features and bins in order break ties."""
    w = Window.partitionBy("window_id", "node", "feature").orderBy("bin")
    whole = Window.partitionBy("window_id", "node", "feature")
    sums = histograms.withColumns({
        "lg": F.sum("g").over(w.rowsBetween(Window.unboundedPreceding, 0)), "ln": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "tg": F.sum("g").over(whole), "tn": F.sum("n").over(whole)})
    part = lambda g, n: (g / UNIT) * (g / UNIT) / (n + settings.l2)
    lg, ln, tg, tn = (F.col(c) for c in ("lg", "ln", "tg", "tn"))
    gain = F.when((ln >= settings.least_rows) & (tn - ln >= settings.least_rows), part(lg, ln) + part(tg - lg, tn - ln) - part(tg, tn))
    errors = F.col("feature") == -1
    gains = sums.withColumn("gain", F.when(~errors, gain))
    order = F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("bin"))
    return gains.groupBy("window_id", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "lg", "ln", "tg", "tn"), order).alias("s")).select("window_id", "node", "s.*")


def fit(rows: DataFrame, spans: dict[int, tuple], width: int, settings: Settings) -> dict[int, Ensemble]:
    """Trees of all windows over binned rows.

    ``spans`` holds, for each window, the first and last day of training,
    validation and test. All windows grow together: a level is one pass over
    the rows, one aggregation, and one row a leaf to the driver, which holds
    the trees alone. A window stops once ``patience`` rounds in a row have not
    lowered its validation error; trees beyond its best round do not count.
    """
    models = {w: Ensemble(w) for w in spans}
    means = _means(rows, spans)
    for w, m in models.items():
        m.base = means.get(w, 0.0)
    active = {w for w in spans if w in means}

    def note(window: int, squared: int, n: int) -> None:
        m = models[window]
        m.errors.append(squared / UNIT / max(n, 1))
        # the first error is that of no tree at all, which is never the best
        if len(m.errors) <= 2 or m.errors[-1] < m.errors[m.best]:
            m.best = len(m.errors) - 1
        elif len(m.errors) - 1 - m.best >= settings.patience:
            active.discard(window)

    for _ in range(settings.rounds):
        growing = {w: Tree.empty(settings.depth) for w in active}
        if not growing:
            break
        open_ = {w: {0} for w in growing}
        for level in range(settings.depth):
            found = _best_splits(_histograms(rows, spans, models, growing, width, settings, level == 0), settings).collect()
            by_window: dict[int, list] = {}
            for r in found:
                if r.node == -1:
                    note(r.window_id, r.tg, r.tn)
                elif r.window_id in growing and r.node in open_[r.window_id]:
                    by_window.setdefault(r.window_id, []).append(r)
            for w, leaves in by_window.items():
                tree = growing[w]
                if level == 0:
                    tree.value[0] = _value(leaves[0].tg, leaves[0].tn, settings)
                room = settings.leaves - len(_leaves(tree))
                for r in sorted(leaves, key=lambda r: (-(r.gain or 0.0), r.node)):
                    if room <= 0 or not r.gain or r.gain <= 1e-12:
                        tree.gain[r.node] = -1
                        continue
                    left, right = 2 * r.node + 1, 2 * r.node + 2
                    tree.feature[r.node], tree.at[r.node], tree.gain[r.node] = r.feature, r.bin, r.gain
                    tree.value[left], tree.value[right] = _value(r.lg, r.ln, settings), _value(r.tg - r.lg, r.tn - r.ln, settings)
                    room -= 1
                open_[w] = {c for r in leaves if tree.feature[r.node] >= 0 for c in (2 * r.node + 1, 2 * r.node + 2)}
            if not any(open_.values()):
                break
        for w in list(growing):
            if w in active:
                models[w].trees.append(growing[w])
    # the error after the last round
    for r in _histograms(rows, spans, models, {}, width, settings, True).where("node = -1").collect():
        if r.window_id in active:
            note(r.window_id, r.g, r.n)
    return models


def _leaves(tree: Tree) -> list[int]:
    out, todo = [], [0]
    while todo:
        k = todo.pop()
        if tree.feature[k] >= 0:
            todo += [2 * k + 1, 2 * k + 2]
        else:
            out.append(k)
    return out


def _value(g: int, n: int, settings: Settings) -> float:
    return settings.rate * (g / UNIT) / (n + settings.l2)


def _means(rows: DataFrame, spans: dict[int, tuple]) -> dict[int, float]:
    """Mean label of the training rows of each window that has any; daily sums are a calendar's size."""
    daily = rows.groupBy("trade_date").agg(F.sum(F.round(F.col("label") * UNIT).cast("long")).alias("y"), F.count(F.lit(1)).alias("n")).collect()
    day = np.array([(np.datetime64(r.trade_date) - _EPOCH).astype(int) for r in daily])
    out = {}
    for w, (train, valid, test) in spans.items():
        inside = {k: (day >= a) & (day <= b) for k, (a, b) in (("train", train), ("valid", valid), ("test", test))} if len(day) else {}
        if inside and all(v.any() for v in inside.values()):
            picked = [daily[i] for i in np.flatnonzero(inside["train"])]
            out[w] = sum(r.y for r in picked) / sum(r.n for r in picked) / UNIT
    return out


def score_tests(rows: DataFrame, spans: dict[int, tuple], models: dict[int, Ensemble], width: int) -> DataFrame:
    """trade_date, symbol, label, window_id, score of the rows of every test span, by the window's own trees."""
    ready = {w: m for w, m in models.items() if m.trees}

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            day, x = _days(b.column("trade_date")), _matrix(b.column("bins"), width)
            for w, m in ready.items():
                own = np.flatnonzero((day >= spans[w][2][0]) & (day <= spans[w][2][1]))
                if len(own):
                    part = b.select(["trade_date", "symbol", "label"]).take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(own), w, np.int32)), pa.array(m.score(x[own]))], names=["trade_date", "symbol", "label", "window_id", "score"])

    return rows.mapInArrow(give, "trade_date date, symbol string, label double, window_id int, score double")


def spans_of(windows: DataFrame) -> dict[int, tuple]:
    """The calendar of windows as day numbers: a row a window comes to the driver."""
    days = lambda d: int((np.datetime64(d) - _EPOCH).astype(int))
    return {r.window_id: tuple((days(r[f"{p}_start"]), days(r[f"{p}_end"])) for p in ("train", "valid", "test")) for r in windows.collect()}


@dataclass
class Walk:
    """A walk-forward run: scores of all test spans, the ensembles, and the features' names."""

    scores: DataFrame
    models: dict[int, Ensemble]
    names: list[str]

    def importance(self) -> list[tuple[str, float]]:
        """Total gain of each feature over the trees that count, as shares, the greatest first."""
        gain = np.zeros(len(self.names))
        for m in self.models.values():
            for tree in m.trees[: m.best]:
                split = tree.feature >= 0
                np.add.at(gain, tree.feature[split], tree.gain[split])
        total = gain.sum() or 1.0
        return sorted(((n, float(g / total)) for n, g in zip(self.names, gain, strict=True)), key=lambda x: (-x[1], x[0]))


def walk_forward(data: DataFrame, windows: DataFrame, names: list[str], label: str, settings: Settings | None = None) -> Walk:
    """Train every window and score its test span.

    Bins are those of the rows up to the end of the first window's training,
    so no edge knows what comes later. Rows without a label take no part.
    Windows without training, validation or test rows have no model. The
    binned rows are written once to the shared folder, in order of their
    dates, so that a task meets few windows.
    """
    settings = settings or Settings()
    spark = data.sparkSession
    spans = spans_of(windows)
    usable = data.where(F.col(label).isNotNull())
    if not spans:
        return Walk(spark.createDataFrame([], "trade_date date, symbol string, label double, window_id int, score double"), {}, names)
    end = F.date_add(F.lit("1970-01-01").cast("date"), min(s[0][1] for s in spans.values()))
    edges = quantile_edges(usable.where(F.col("trade_date") <= end), names, settings.bins)
    folder = Folder(spark, "boosting")
    coded = binned(usable, names, label, edges)
    parts = spark.sparkContext.defaultParallelism
    coded.repartitionByRange(parts, "trade_date", "symbol").write.parquet(folder.path("binned"))
    rows = spark.read.schema(_BINNED).parquet(folder.path("binned"))
    models = fit(rows, spans, len(names), settings)
    return Walk(score_tests(rows, spans, models, len(names)), models, names)
