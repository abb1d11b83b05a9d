"""Toxic spans by a linear-chain conditional random field over word tokens."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import Remembered

TOKEN = re.compile(r"[^\W\d_]+")
BITS = 18
#: Features a token has: the word, its first 3 to 6 letters, its last 3, its length.
FEATURES = 7
#: Neighbours are held back: what one document alone says must not count.
CONTEXT_DECAY = 1e-3
#: Tokens scored in one sweep, and words of one generation that a task remembers.
SWEEP, REMEMBERED = 300_000, 80_000
#: Tokens of one block of the training set: the arrays of a step are as long as a block, not as the set.
FITTED = 200_000
#: The document score takes the surest tokens only, so that length alone adds nothing.
SUREST = 5


@dataclass(frozen=True)
class Crf:
    """Weights of 2 ** BITS hashed features for state 1 against 0, transitions and starts (log scale).

    ``before`` and ``after`` weigh the words next to a token, hashed alike.
    """

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    before: np.ndarray | None = None
    after: np.ndarray | None = None


def features(word: str) -> list[int]:
    """Hashed features of a lower-cased word."""
    parts = (f"w={word}", f"3={word[:3]}", f"4={word[:4]}", f"5={word[:5]}", f"6={word[:6]}", f"e={word[-3:]}", f"n={min(len(word), 20)}")
    return [zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts]


def _feature_rows(words: list[str]) -> np.ndarray:
    return np.array([features(w) for w in words], np.int32).reshape(len(words), FEATURES)


def _numbered(sample: list[tuple[int, str, int]]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """The words met, the documents as numbers of words, and the documents' labels.

    One document of each set of near copies counts, so that copies don't count
    as further witnesses: two documents are taken as copies where one of two
    min-hashes of their word triples agrees. Words are held once, tokens as
    four bytes each.
    """
    place: dict[str, int] = {}
    seen: set = set()
    docs, labels = [], []
    for _, text, y in sample:
        words = [w.lower() for w in TOKEN.findall(text)]
        triples = [zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))]
        marks = {(0, min(triples)), (1, max(triples))}
        if seen.isdisjoint(marks):
            docs.append(np.array([place.setdefault(w, len(place)) for w in words], np.int32))
            labels.append(y)
        seen |= marks
    return list(place), docs, np.array(labels, int)


def label_tokens(docs: Iterable[list[str]], labels: np.ndarray, least: int = 8, ratio: float = 30.0) -> dict[str, int]:
    """Word to 0 or 1, from the labelled documents that hold it.

    A word is labelled toxic where it, or a prefix of 4 to 6 letters, occurs in
    at least ``least`` toxic documents and ``ratio`` times as often in them as
    in the others.
    """
    def keys(word: str) -> set[str]:
        return {f"w={word}", *(f"{n}={word[:n]}" for n in (4, 5, 6) if len(word) >= n)}

    seen = (Counter(), Counter())
    vocabulary = set()
    for words, y in zip(docs, labels, strict=True):
        own = set(words)
        vocabulary |= own
        seen[int(y)].update(set().union(*map(keys, own)) if own else ())
    n = [max(1, int((labels == y).sum())) for y in (0, 1)]
    toxic = {k for k, v in seen[1].items() if v >= least and (v / n[1]) >= ratio * ((seen[0][k] + 0.5) / n[0])}
    return {w: int(not toxic.isdisjoint(keys(w))) for w in vocabulary}


def _scan(emission: np.ndarray, fresh: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Forward and backward messages (f0, f1, b0, b1) of many documents laid end to end.

    emission (n,) is the log potential of state 1 against 0; fresh marks first
    tokens, whose step ignores the state before. The sequence is folded into
    about sqrt(n) lanes; products of each lane's 2 x 2 steps come first, then
    the messages between lanes, then those within lanes, so each sweep is a
    loop of whole-array steps over the lanes. Messages are scaled to sum 1.
    """
    n = len(emission)
    lanes = max(1, int(np.sqrt(n)))
    cols = -(-n // lanes)
    pot1 = np.exp(np.clip(emission, -50, 50))
    pot0 = 1 / (1 + pot1)
    pot1 = pot1 * pot0
    t, s = np.exp(trans), np.exp(start)

    def laid(x: np.ndarray, fill: float) -> np.ndarray:
        whole = np.full(lanes * cols, fill)
        whole[:n] = x
        return np.ascontiguousarray(whole.reshape(lanes, cols).T)

    s00, s10 = (laid(np.where(fresh, s[0], t[k, 0]) * pot0, float(k == 0)) for k in (0, 1))
    s01, s11 = (laid(np.where(fresh, s[1], t[k, 1]) * pot1, float(k == 1)) for k in (0, 1))
    p00, p01, p10, p11 = np.ones(lanes), np.zeros(lanes), np.zeros(lanes), np.ones(lanes)
    for c in range(cols):
        p00, p01, p10, p11 = p00 * s00[c] + p01 * s10[c], p00 * s01[c] + p01 * s11[c], p10 * s00[c] + p11 * s10[c], p10 * s01[c] + p11 * s11[c]
        if c % 8 == 7:
            k = 1 / (p00 + p01 + p10 + p11)
            p00, p01, p10, p11 = p00 * k, p01 * k, p10 * k, p11 * k
    enter, leave = np.empty((2, lanes)), np.empty((2, lanes))
    x, y = 0.5, 0.5
    for r in range(lanes):
        enter[:, r] = x, y
        x, y = x * p00[r] + y * p10[r], x * p01[r] + y * p11[r]
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for r in range(lanes - 1, -1, -1):
        leave[:, r] = x, y
        x, y = p00[r] * x + p01[r] * y, p10[r] * x + p11[r] * y
        x, y = x / (x + y), y / (x + y)
    f0, f1, b0, b1 = (np.empty((cols, lanes)) for _ in range(4))
    x, y = enter
    for c in range(cols):
        x, y = x * s00[c] + y * s10[c], x * s01[c] + y * s11[c]
        k = 1 / (x + y)
        f0[c], f1[c] = x, y = x * k, y * k
    x, y = leave
    for c in range(cols - 1, -1, -1):
        b0[c], b1[c] = x, y
        x, y = s00[c] * x + s01[c] * y, s10[c] * x + s11[c] * y
        k = 1 / (x + y)
        x, y = x * k, y * k
    return tuple(m.T.reshape(-1)[:n] for m in (f0, f1, b0, b1))


def marginals(crf: Crf, emission: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Probability of state 1 of each token. A first token's backward message never crosses into the document before."""
    if not len(emission):
        return np.zeros(0)
    # what comes after a document's end is a first token: its step has equal rows, so the message back is flat
    f0, f1, b0, b1 = _scan(emission, fresh, crf.trans, crf.start)
    return f1 * b1 / (f0 * b0 + f1 * b1)


def fit(sample: list[tuple[int, str, int]], rounds: int = 40, rate: float = 0.25, decay: float = 1e-5) -> Crf:
    """Maximise the conditional likelihood of the token labels with Adam.

    ``sample`` holds (id, text, label) rows. A token is labelled toxic where
    ``label_tokens`` says so of its word and its document is labelled toxic:
    the same word is clean in a clean document, so what tells the two apart
    must come from its neighbours and from the chain. Without toxic rows, or
    without words, every token is scored as clean. The gradient is summed over
    blocks of whole documents.
    """
    words, docs, labels = _numbered(sample)
    par = {"weights": np.zeros(1 << BITS), "before": np.zeros(1 << BITS), "after": np.zeros(1 << BITS), "trans": np.zeros((2, 2)), "start": np.array([0.0, -4.0])}
    n_docs = sum(len(d) > 0 for d in docs)
    if n_docs == 0 or labels.sum() in (0, len(labels)):
        return Crf(par["weights"], np.array([[0.0, -8.0], [0.0, -8.0]]), np.array([0.0, -8.0]))
    gold_of = label_tokens(([words[i] for i in np.unique(d)] for d in docs), labels)
    telling = np.array([gold_of[w] for w in words], np.int8)
    rows = _feature_rows(words)
    blocks = [_Block.of(part, telling) for part in _parts(docs, labels)]
    mean = {k: np.zeros_like(v) for k, v in par.items()}
    var = {k: np.zeros_like(v) for k, v in par.items()}
    for step in range(1, rounds + 1):
        grad = {k: np.zeros_like(v) for k, v in par.items()}
        by_word = np.zeros(len(words))
        own = par["weights"][rows].sum(1)
        for block in blocks:
            _add_gradient(grad, by_word, par, own, rows[:, 0], block)
        grad["weights"] = np.bincount(rows.ravel(), np.repeat(by_word, FEATURES), minlength=1 << BITS)
        for k in grad:
            grad[k] = grad[k] / n_docs + (CONTEXT_DECAY if k in ("before", "after") else 0.0 if k == "start" else decay) * par[k]
        for k, g in grad.items():
            mean[k] = 0.9 * mean[k] + 0.1 * g
            var[k] = 0.99 * var[k] + 0.01 * g * g
            par[k] = par[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.99**step)) + 1e-8)
    return Crf(par["weights"], par["trans"], par["start"], par["before"], par["after"])


def _parts(docs: list[np.ndarray], labels: np.ndarray) -> Iterator[list[tuple[np.ndarray, int]]]:
    """Documents that hold words, with their labels, in blocks of about FITTED tokens."""
    held, size = [], 0
    for d, y in zip(docs, labels, strict=True):
        if len(d):
            held.append((d, int(y)))
            size += len(d)
        if size >= FITTED:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass(frozen=True)
class _Block:
    """Whole documents end to end: numbers of words, marks of first tokens, token labels, counts of label pairs within documents."""

    seq: np.ndarray
    fresh: np.ndarray
    gold: np.ndarray
    told: np.ndarray

    @staticmethod
    def of(part: list[tuple[np.ndarray, int]], telling: np.ndarray) -> _Block:
        seq = np.concatenate([d for d, _ in part])
        fresh = np.zeros(len(seq), bool)
        fresh[np.cumsum([0, *(len(d) for d, _ in part[:-1])])] = True
        gold = telling[seq] * np.repeat(np.array([y for _, y in part], np.int8), [len(d) for d, _ in part])
        told = np.bincount((2 * gold[:-1] + gold[1:])[~fresh[1:]], minlength=4).reshape(2, 2)
        return _Block(seq, fresh, gold, told)


def _add_gradient(grad: dict[str, np.ndarray], by_word: np.ndarray, par: dict[str, np.ndarray], own: np.ndarray, hashed: np.ndarray, block: _Block) -> None:
    """Adds one block's part of the gradient; ``own`` is each word's own score and ``hashed`` its hashed feature."""
    name, fresh, inner = hashed[block.seq], block.fresh, ~block.fresh[1:]
    emission = own[block.seq] + _beside(par["before"][name], par["after"][name], fresh)
    f0, f1, b0, b1 = _scan(emission, fresh, par["trans"], par["start"])
    post = f1 * b1 / (f0 * b0 + f1 * b1)
    ahead = b0[1:], b1[1:] * np.exp(np.clip(emission[1:], -50, 50))
    t = np.exp(par["trans"])
    each = np.stack([f * t[i, j] * ahead[j] for i, f in enumerate((f0[:-1], f1[:-1])) for j in (0, 1)])
    error = post - block.gold
    by_word += np.bincount(block.seq, error, minlength=len(by_word))
    grad["before"] += np.bincount(name[:-1][inner], error[1:][inner], minlength=1 << BITS)
    grad["after"] += np.bincount(name[1:][inner], error[:-1][inner], minlength=1 << BITS)
    grad["trans"] += (each / each.sum(0))[:, inner].sum(1).reshape(2, 2) - block.told
    grad["start"] += np.array([-1.0, 1.0]) * error[fresh].sum()


def _beside(before: np.ndarray, after: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """What the neighbours add to each token: the word before it and the word after it, within the document."""
    out = np.zeros(len(fresh))
    inner = ~fresh[1:]
    out[1:][inner] += before[:-1][inner]
    out[:-1][inner] += after[1:][inner]
    return out


def _emissions(crf: Crf, docs: list[list[str]], fresh: np.ndarray, memory: Remembered) -> np.ndarray:
    place: dict[str, int] = {}
    seq = np.array([place.setdefault(w, len(place)) for d in docs for w in d], np.int64)
    memory.turn()
    new = memory.known(list(place))
    for i in range(0, len(new), 50_000):
        part = new[i : i + 50_000]
        rows = _feature_rows([w.lower() for w in part])
        beside = [x[rows[:, 0]].tolist() if x is not None else [0.0] * len(part) for x in (crf.before, crf.after)]
        memory.young.update(zip(part, zip(crf.weights[rows].sum(1).tolist(), *beside, strict=True), strict=True))
    get = memory.young.__getitem__
    values = np.array([get(w) for w in place], np.float64).reshape(len(place), 3)
    return values[seq, 0] + _beside(values[seq, 1], values[seq, 2], fresh)


def tag_texts(crf: Crf, texts: list[str | None], cut: float = 0.5, memory: Remembered | None = None) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """A score in 0..1 for each text, and its spans (start, end, probability) over ``cut`` in code points.

    The score is 1 - prod(1 - p) over the SUREST largest marginals; a text
    without words scores 0.
    """
    memory = Remembered(REMEMBERED) if memory is None else memory
    scores, spans = np.zeros(len(texts)), [[] for _ in texts]
    held: list[list[str]] = []
    first = size = 0
    for i, text in enumerate(texts):
        held.append(TOKEN.findall(text or ""))
        size += len(held[-1])
        if size < SWEEP and i < len(texts) - 1:
            continue
        lengths = np.array([len(d) for d in held])
        starts = np.cumsum(lengths) - lengths
        fresh = np.zeros(size, bool)
        fresh[starts[lengths > 0]] = True
        prob = marginals(crf, _emissions(crf, held, fresh, memory), fresh)
        for d in np.flatnonzero(lengths):
            own = prob[starts[d] : starts[d] + lengths[d]]
            top = np.partition(own, -SUREST)[-SUREST:] if len(own) > SUREST else own
            scores[first + d] = 1 - np.prod(1 - top)
            if top.max() > cut:
                places = [m.span() for m in TOKEN.finditer(texts[first + d])]
                spans[first + d] = [(*places[k], float(own[k])) for k in np.flatnonzero(own > cut)]
        held, first, size = [], i + 1, 0
    return scores, spans


def score_column(crf: Crf, text: Column) -> Column:
    """struct(score, spans) of every text in Arrow batches; spans are array<struct<start,end,prob>>.

    Null, empty and wordless texts score 0 without spans; long texts are tagged
    whole; equal texts have equal results; an empty table gives no rows. It is
    a column, so the table's other columns and their names don't matter.
    """

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,prob:double>>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory = Remembered(REMEMBERED)
        for texts in batches:
            scores, spans = tag_texts(crf, [t if isinstance(t, str) else None for t in texts], memory=memory)
            rows = [[{"start": a, "end": b, "prob": p} for a, b, p in s] for s in spans]
            yield pd.DataFrame({"score": scores, "spans": rows})

    return tag(text)
