"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import give_back

#: A chunk and the step to the next one, in bytes: neighbours overlap by CHUNK - HOP.
CHUNK, HOP = 512, 448
WIDTH, STEP, DEPTH, FILTERS = 8, 4, 8, 24
POSITIONS = (CHUNK - WIDTH) // STEP + 1
#: Score from which a text counts as good.
KEEP_FROM = 0.3
#: Code of the padding; bytes keep their value.
PAD = 256
#: Chunks that are convolved at once (about 25 MB of windows).
SLAB = 768


@dataclass(frozen=True)
class Net:
    """Embedding, filters and output weights; about 30 KB whatever the corpus."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: float


def chunks_of(text: str | None) -> np.ndarray:
    """(chunks, CHUNK) byte codes that cover the whole text; an empty text has one chunk of padding."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP)) if len(data) > CHUNK else 1
    codes = np.full((n - 1) * HOP + CHUNK, PAD, np.int16)
    codes[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(codes, CHUNK)[::HOP]


def _windows(net_embed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(chunks, POSITIONS, WIDTH * DEPTH) embedded windows."""
    flat = net_embed[codes].reshape(len(codes), CHUNK * DEPTH)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DEPTH, axis=1)
    return view[:, :: STEP * DEPTH]


def _pooled(net: Net, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Max-pooled activations (chunks, FILTERS), their positions, and the windows."""
    windows = np.ascontiguousarray(_windows(net.embed, codes))
    act = windows.reshape(-1, WIDTH * DEPTH) @ net.kernel
    act = act.reshape(len(codes), POSITIONS, FILTERS)
    at = act.argmax(1)
    top = np.take_along_axis(act, at[:, None], 1)[:, 0] + net.bias
    return np.maximum(top, 0), at, windows


def pooled(net: Net, codes: np.ndarray) -> np.ndarray:
    """Max-pooled activations of any number of chunks, in slabs of bounded memory."""
    found = []
    for i in range(0, len(codes), SLAB):
        part = np.ascontiguousarray(_windows(net.embed, codes[i : i + SLAB]))
        act = (part.reshape(-1, WIDTH * DEPTH) @ net.kernel).reshape(len(part), POSITIONS, FILTERS)
        found.append(np.maximum(act.max(1) + net.bias, 0))
    return np.concatenate(found)


def fit(sample: list[tuple[int, str, int]], epochs: int = 8, chunks_a_text: int = 3, batch: int = 48, rate: float = 4e-3,
        seed: int = 7) -> Net:
    """Train on (id, text, label) rows by Adam on the cross entropy of the text's probability.

    Each epoch sees up to ``chunks_a_text`` chunks of a text, drawn anew from
    the whole text. With one class or no rows at all the net returns that
    class's share (a half without rows).
    """
    rng = np.random.default_rng(seed)
    labels = np.array([y for _, _, y in sample], np.float32)
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    par = {
        "embed": rng.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32),
        "kernel": rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, FILTERS).astype(np.float32),
        "base": np.array([np.log(share / (1 - share))], np.float32),
    }
    par["embed"][PAD] = 0
    if 0 < labels.sum() < len(labels):
        texts = [chunks_of(t) for _, t, _ in sample]
        mean, var, step = ({k: np.zeros_like(v) for k, v in par.items()} for _ in range(2)), None, 0
        mean, var = mean
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                drawn = [texts[r] if len(texts[r]) <= chunks_a_text else texts[r][rng.choice(len(texts[r]), chunks_a_text, False)] for r in rows]
                owner = np.repeat(np.arange(len(rows)), [len(d) for d in drawn])
                grad = _gradient(par, np.concatenate(drawn), owner, labels[rows])
                step += 1
                for k, g in grad.items():
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    var[k] = 0.999 * var[k] + 0.001 * g * g
                    par[k] = par[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)
                par["embed"][PAD] = 0
    return Net(par["embed"], par["kernel"], par["bias"], par["out"], float(par["base"][0]))


def _gradient(par: dict, codes: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> dict:
    net = Net(par["embed"], par["kernel"], par["bias"], par["out"], float(par["base"][0]))
    top, at, windows = _pooled(net, codes)
    counts = np.bincount(owner, minlength=len(labels)).astype(np.float32)[:, None]
    pool = np.zeros((len(labels), FILTERS), np.float32)
    np.add.at(pool, owner, top)
    pool /= counts
    score = 1 / (1 + np.exp(-np.clip(pool @ net.out + net.base, -30, 30)))
    error = ((score - labels) / len(labels)).astype(np.float32)
    back = (error[:, None] * net.out / counts)[owner] * (top > 0)
    picked = np.take_along_axis(windows, at[:, :, None], 1)
    kernel = np.einsum("cfw,cf->wf", picked, back, optimize=True)
    spread = (back[:, :, None] * net.kernel.T).reshape(len(codes), FILTERS, WIDTH, DEPTH)
    places = at[:, :, None] * STEP + np.arange(WIDTH)
    embed = np.zeros_like(par["embed"])
    np.add.at(embed, codes[np.arange(len(codes))[:, None, None], places], spread)
    return {"embed": embed, "kernel": kernel, "bias": back.sum(0), "out": error @ pool + 1e-4 * net.out, "base": np.array([error.sum()], np.float32)}


def score_texts(net: Net, texts: list[str | None]) -> np.ndarray:
    """One probability a text: activations are max-pooled in each chunk, averaged over all chunks, and combined."""
    out = np.empty(len(texts), np.float64)
    held: list[np.ndarray] = []
    first = size = 0
    for i, text in enumerate(texts):
        held.append(chunks_of(text))
        size += len(held[-1])
        if size >= SLAB or i == len(texts) - 1:
            top = pooled(net, np.concatenate(held))
            starts = np.cumsum([0, *(len(h) for h in held[:-1])])
            mean = np.add.reduceat(top, starts, axis=0) / np.array([len(h) for h in held])[:, None]
            out[first : i + 1] = 1 / (1 + np.exp(-np.clip(mean @ net.out + net.base, -30, 30)))
            held, first, size = [], i + 1, 0
    return out


def score_column(net: Net, text: Column) -> Column:
    """Probability of label 1 for every text, in Arrow batches.

    Null and empty texts are one chunk of padding and have that chunk's score;
    texts of any length are scored whole, in slabs of bounded memory; equal
    texts have equal scores; an empty table gives no rows. It is a column, so
    the table's other columns and their names don't matter.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(net, [t if isinstance(t, str) else None for t in texts]))
        give_back()

    return score(text)
