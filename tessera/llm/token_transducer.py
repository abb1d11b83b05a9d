"""Token counts by compiled finite-state transducers whose chunk maps compose by a prefix scan."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import Remembered, Units, array_sweeps, code_points, sweeps

# Fixed values of the byte-level format: the split pattern that the machine of pretokens implements, and the code points that stand for bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Code points of a chunk; states and transitions that the counting machine keeps; border tests that it keeps; pretokens of one generation that a task remembers.
CHUNK, STATES, ARCS, FITS, REMEMBERED, SHORT = 128, 150_000, 600_000, 500_000, 80_000, 64

# Input classes and states of the machine of pretokens.
LETTER, ALONE, R, V, L, E, NUMBER, OTHER, QUOTE, BLANK, WHITE, RESET = range(12)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_BLANK, AFTER_WHITE, AFTER_QUOTE, SUFFIX, QUOTE_R, QUOTE_V, QUOTE_L = range(11)
_LETTERS = (LETTER, ALONE, R, V, L, E)


def _next_state(state: int, c: int) -> int:
    """Where the machine of pretokens goes on an input of class ``c``."""
    if c in _LETTERS:
        if state == AFTER_QUOTE:
            return {ALONE: SUFFIX, R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}.get(c, IN_LETTERS)
        ends = (state in (QUOTE_R, QUOTE_V) and c == E) or (state == QUOTE_L and c == L)
        return SUFFIX if ends else IN_LETTERS
    if c == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AFTER_QUOTE, AFTER_BLANK) else AFTER_QUOTE
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, BLANK: AFTER_BLANK, WHITE: AFTER_WHITE, RESET: START}[c]


def _begins(state: int, c: int, ahead: int) -> bool:
    """Whether a pretoken begins at an input of class ``c`` that is read in ``state`` and followed by one of class ``ahead``."""
    letter, white = c in _LETTERS, c in (BLANK, WHITE)
    if state == START:
        return True
    if white:
        # of a run of white space the last one stands apart, unless the text ends
        return state not in (AFTER_BLANK, AFTER_WHITE) or ahead not in (BLANK, WHITE, RESET)
    if state in (AFTER_BLANK, AFTER_WHITE):
        return state == AFTER_WHITE
    if state == AFTER_QUOTE:
        if letter:
            return not (c == ALONE or (c in (R, V) and ahead == E) or (c == L and ahead == L))
        return c == NUMBER
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        return not letter
    if state == IN_LETTERS:
        return not letter
    if state == IN_NUMBERS:
        return c != NUMBER
    if state == IN_OTHERS:
        return c not in (OTHER, QUOTE)
    return True  # after a suffix


class PretokenMachine:
    """Deterministic machine over input classes that tells where pretokens begin, with one class of look-ahead.

    Its transition monoid is finite: the maps that strings induce on the
    states. Every map has a number, and ``product`` holds the number of each
    composition, so the map of a chunk is folded by table look-ups and the
    maps of all chunks compose in a parallel prefix scan.
    """

    def __init__(self) -> None:
        kinds, states = range(RESET + 1), range(QUOTE_L + 1)
        self.step = np.array([[_next_state(s, c) for c in kinds] for s in states], np.uint8)
        begins = np.array([[[_begins(s, c, a) for a in kinds] for c in kinds] for s in states])
        self.begins = begins.ravel()
        maps = {tuple(states): 0}
        queue = [tuple(states)]
        letters = [tuple(int(x) for x in self.step[:, c]) for c in kinds]
        for m in queue:
            for g in letters:
                made = tuple(g[s] for s in m)
                if made not in maps:
                    maps[made] = len(maps)
                    queue.append(made)
        table = np.array(queue, np.uint8)
        self.letter = np.array([maps[g] for g in letters], np.int32)
        self.to = table
        self.product = np.array([[maps[tuple(b[a].tolist())] for b in table] for a in table], np.int32)
        # classes of all code points, by the same properties as the pattern's
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.classes = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WHITE)):
            self.classes[code_points("".join(regex.findall(pattern, every)))] = kind
        for letters_of, kind in (("stmd", ALONE), ("r", R), ("v", V), ("l", L), ("e", E), ("'", QUOTE), (" ", BLANK)):
            self.classes[[ord(c) for c in letters_of]] = kind

    def scan(self, maps: np.ndarray) -> np.ndarray:
        """Inclusive prefixes of a sequence of maps: log2(n) rounds, each composing all pairs at once."""
        maps, reach = maps.copy(), 1
        while reach < len(maps):
            maps[reach:] = self.product[maps[:-reach], maps[reach:]]
            reach *= 2
        return maps

    def begins_at(self, kinds: np.ndarray, chunk: int) -> np.ndarray:
        """For every input whether a pretoken begins there."""
        n = len(kinds)
        lanes = -(-n // chunk)
        padded = np.full(lanes * chunk + 1, RESET, np.uint8)
        padded[:n] = kinds
        by_step = np.ascontiguousarray(padded[:-1].reshape(lanes, chunk).T)
        whole = np.zeros(lanes, np.int32)
        for row in by_step:
            whole = self.product[whole, self.letter[row]]
        state = np.zeros(lanes, np.uint8)
        state[1:] = self.to[self.scan(whole)[:-1], START]
        before = np.empty((chunk, lanes), np.uint8)
        for i, row in enumerate(by_step):
            before[i] = state
            state = self.step[state, row]
        flat = before.T.reshape(-1)[:n].astype(np.int32)
        return self.begins[(flat * (RESET + 1) + padded[:n]) * (RESET + 1) + padded[1 : n + 1]]


class CountingMachine:
    """Deterministic transducer from the bytes of a pretoken to the number of its tokens.

    A byte-pair encoding is told from other spellings by its neighbours alone:
    a sequence of tokens is the encoding of its bytes when each two neighbours
    are that of theirs. So the encoder is a finite machine over (last token,
    trie node of the token being read). It is made deterministic on demand:
    a state is the set of such configurations, each with the tokens that it
    has beyond the least of the set; a transition is annotated with the tokens
    by which the least grows, which is what it emits; the surplus of the
    configuration that stands between tokens is emitted at the end.
    """

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[int, int, int]]):
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b, made in merges:
            self.parts.setdefault(made, (a, b))
        # the trie of tokens: node number by (node, byte), token by node, nodes that have children
        self.child: dict[int, int] = {}
        self.token = [-1]
        for spelled, number in vocabulary.items():
            if len(spelled) > 1 and number not in self.parts:
                continue  # nothing merges to it
            node = 0
            for b in spelled:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = number
        self.inner = bytearray(len(self.token))
        for key in self.child:
            self.inner[key >> 8] = 1
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, int], list] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states; they come back when they are met."""
        self.number: dict[tuple, int] = {}
        self.configurations: list[tuple] = []
        self.final: list[int] = []
        self.arcs: dict[int, int] = {}
        if len(self.fits) > FITS:
            self.fits.clear()
        self._state(((-1, 0, 0),))

    def _state(self, configurations: tuple) -> int:
        found = self.number.get(configurations)
        if found is None:
            found = self.number[configurations] = len(self.configurations)
            self.configurations.append(configurations)
            self.final.append(configurations[-1][2])
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int, int]]:
        """What stands at a token's border (side 1: its end, 0: its start) as it is built: (symbol, rank that makes it, rank that absorbs it, what absorbs it)."""
        found = self.spines.get((token, side))
        if found is None:
            found, gone, into, now = [], len(self.rank), -1, token
            while True:
                made = self.rank[self.parts[now]] if now in self.parts else -1
                found.append((now, made, gone, into))
                if made < 0:
                    break
                gone, into, now = made, now, self.parts[now][side]
            self.spines[token, side] = found
        return found

    def _fit(self, left: int, right: int) -> bool:
        """Whether two tokens that stand side by side stay as they are: no pair across the border has its turn while both its symbols stand there."""
        rank = self.rank
        for a, made_a, gone_a, _ in self._spine(left, 1):
            for b, made_b, gone_b, into_b in self._spine(right, 0):
                across = rank.get((a, b))
                if across is None or across >= gone_a or across > gone_b or across < made_a or across < made_b:
                    continue
                # of equal pairs the leftmost merges first: the one across the border lies before that within the right token
                if across < gone_b or (a, b) == self.parts[into_b]:
                    return False
        return True

    def compile(self, state: int, byte: int) -> int:
        """The transition of a state on a byte: next state and what it emits, packed. Configurations that can't go on are left out."""
        child, token, inner, fits = self.child, self.token, self.inner, self.fits
        moved, whole, least = [], None, 1 << 30
        for last, node, r in self.configurations[state]:
            to = child.get(node << 8 | byte)
            if to is None:
                continue
            if inner[to]:
                moved.append((last, to, r))
                if r < least:
                    least = r
            name = token[to]
            if name >= 0 and whole is None:
                pair = (last, name)
                fit = fits.get(pair)
                if fit is None:
                    fit = fits[pair] = last < 0 or self._fit(last, name)
                if fit:
                    whole = (name, 0, r + 1)
        moved.append(whole)
        least = min(least, whole[2])
        if least:
            moved = [(last, node, r - least) for last, node, r in moved]
        to = self._state(tuple(moved))
        arc = self.arcs[state << 8 | byte] = to << 8 | least
        return arc

    def count(self, pretoken: bytes) -> int:
        """Tokens of a pretoken."""
        if len(self.configurations) > STATES or len(self.arcs) > ARCS:
            self.clear()
        state = total = 0
        get = self.arcs.get
        for byte in pretoken:
            arc = get(state << 8 | byte)
            if arc is None:
                arc = self.compile(state, byte)
            state = arc >> 8
            total += arc & 255
        return total + self.final[state]


class Transducer:
    """Counter of one byte-level BPE vocabulary (.json): the machine of pretokens, and behind it the counting machine."""

    def __init__(self, json_file: str):
        with open(json_file, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        extra = spec.get("added_tokens", [])
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE vocabularies without normaliser are supported")
        if spec["pre_tokenizer"].get("add_prefix_space") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in extra):
            raise ValueError("prefix spaces, and special tokens that strip or hold white space, are not supported")
        code = {chr(p): p for p in PRINTED}
        others = [b for b in range(256) if b not in code.values()]
        code |= {chr(256 + i): b for i, b in enumerate(others)}
        as_bytes = lambda s: bytes(code[c] for c in s)
        number = {as_bytes(s): i for s, i in model["vocab"].items() if all(c in code for c in s)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.counting = CountingMachine(number, [(number[as_bytes(a)], number[as_bytes(b)], number[as_bytes(a + b)]) for a, b in pairs])
        self.pretokens = PretokenMachine()
        special = sorted((t["content"] for t in extra if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.units = Units()
        self.memory = Remembered(REMEMBERED)

    def release(self) -> None:
        """Let go of everything that texts have brought."""
        self.memory = Remembered(REMEMBERED)
        self.counting.fits.clear()
        self.counting.spines.clear()
        self.counting.clear()

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text. Texts follow one another with a reset between; special strings are one token each and a reset too."""
        out: list[int] = []
        for sweep in sweeps(texts):
            parts, owner, fixed = [], [], [0] * len(sweep)
            for k, text in enumerate(sweep):
                pieces = [text]
                if self.special is not None and self.special.search(text):
                    pieces = self.special.split(text)
                    fixed[k] = len(pieces) - 1
                parts += pieces
                owner += [k] * len(pieces)
            found = np.array(fixed, np.int64)
            np.add.at(found, owner, self._counts(parts, chunk))
            out += found.tolist()
        return out

    def _counts(self, parts: list[str], chunk: int) -> np.ndarray:
        text = "\n".join(parts) + "\n"
        ends_at = np.cumsum([len(p) + 1 for p in parts]) - 1
        points = code_points(text)
        kinds = self.pretokens.classes[points]
        kinds[ends_at] = RESET
        begins = self.pretokens.begins_at(kinds, chunk)
        begins[ends_at] = True  # the reset closes what is open
        marks = np.flatnonzero(begins)
        real = kinds[marks] != RESET
        starts, ends = marks[real], np.r_[marks[1:], len(points)][real]
        if not len(starts):
            return np.zeros(len(parts), np.int64)
        first, kind = self.units.distinct(points, starts, ends)
        names = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.memory.turn()
        new = self.memory.known(names)
        held, long, count = self.memory.young, {}, self.counting.count
        for name in new:
            (held if len(name) <= SHORT else long)[name] = count(name.encode("utf-8", "replace"))
        each = np.array([held[n] if len(n) <= SHORT else long[n] for n in names], np.int64)[kind]
        sums = np.r_[0, np.cumsum(each)]
        return np.diff(np.r_[0, sums[np.searchsorted(starts, ends_at)]])


@lru_cache(maxsize=1)
def transducer(json_file: str) -> Transducer:
    """The process's machines of a vocabulary file."""
    return Transducer(json_file)


def count_column(text: Column, json_file: str) -> Column:
    """Number of tokens of every text, in Arrow batches.

    Null and empty texts have none; texts of any length go through the same
    chunk maps; equal texts have equal counts; an empty table gives no rows.
    It is a column, so other columns don't matter. States and pretokens that
    a task has met are let go at its end.
    """

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = transducer(json_file)
        try:
            for batch in batches:
                yield pa.array([n for texts in array_sweeps(batch) for n in own.counts(texts)], pa.int64())
        finally:
            own.release()
            pa.default_memory_pool().release_unused()

    return count(text)
