"""SentencePiece encoding and decoding for merge-type vocabularies by a score-ordered agenda."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bpe_tables import PairTable, merge_all
from .common import give_back
from .units import Remembered, Units, array_sweeps, code_points, gathered

SPACE = "▁"
#: Units of one generation that a task remembers, and letters up to which a unit is remembered.
REMEMBERED, SHORT = 60_000, 64
#: Code points that are encoded at once; bounds the memory of a worker.
CODED = 300_000
#: Code points of a text that the library encodes whole in each Arrow batch, besides every new unit.
WHOLE = 4096


class Codec:
    """Encoder and decoder of one model file (kind BPE, no normalisation but white space marks, byte fallback).

    Text is cut into units wherever no piece holds the two neighbouring code
    points, so that no merge can cross a cut. Each distinct unit of a sweep is
    merged once by the agenda: of all adjacent symbol pairs whose union is a
    piece, that with the highest score, then the leftmost, merges first. New
    units that start with a space mark, and a whole text of every Arrow batch,
    are checked against the library; a difference raises.
    """

    def __init__(self, model_file: str, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib, n = self.library, self.library.get_piece_size()
        self.check, self.eos, self.base = check, lib.eos_id(), n
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        ids = {lib.id_to_piece(i): i for i in plain}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if lib.is_byte(i):
                self.byte_id[int(lib.id_to_piece(i)[3:5], 16)] = i
        self.names = [str(i) for i in range(n)]
        self.bytes_of = [b"" if lib.is_control(i) else lib.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_id.tolist()):
            self.bytes_of[i] = bytes([b])
        # symbols: ids of the vocabulary, then one for each code point without a piece of its own
        self.symbol_of = np.arange(n, n + 0x110000, dtype=np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol_of[ord(piece)] = i
        known = lambda part: ids.get(part, n + ord(part) if len(part) == 1 else None)
        level = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        rows = [
            (a, b, level[lib.get_score(i)], i)
            for piece, i in ids.items() for k in range(1, len(piece)) if (a := known(piece[:k])) is not None and (b := known(piece[k:])) is not None
        ]
        self.table = PairTable(*np.array(rows, np.int64).T, n + 0x110000)
        # which code points stand next to each other inside a piece
        letters = sorted({c for p in ids if len(p) > 1 for c in p})
        self.place = np.full(0x110000, len(letters), np.int32)
        self.place[[ord(c) for c in letters]] = np.arange(len(letters))
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in ids:
            at = self.place[[ord(c) for c in p]]
            self.joined[at[:-1], at[1:]] = True
        mark = self.place[ord(SPACE)]
        if self.joined[:, mark].sum() > self.joined[mark, mark]:
            raise ValueError("pieces that hold a space mark after other letters are not supported")
        self.units = Units()
        self.memory = Remembered(REMEMBERED)

    def _spelled(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece become the bytes of their code point."""
        other = np.flatnonzero(symbols >= self.base)
        if not len(other):
            return symbols, lengths
        kinds, which = np.unique(symbols[other], return_inverse=True)
        spelled = [chr(s - self.base).encode("utf-8", "replace") for s in kinds.tolist()]
        sizes = np.array([len(b) for b in spelled])
        flat = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
        width = np.ones(len(symbols), np.int64)
        width[other] = sizes[which]
        begin = np.cumsum(width) - width
        out = np.empty(int(width.sum()), np.int64)
        plain = np.flatnonzero(symbols < self.base)
        out[begin[plain]] = symbols[plain]
        out[np.arange(int(width[other].sum())) + np.repeat(begin[other] - (np.cumsum(width[other]) - width[other]), width[other])] = gathered(flat, (np.cumsum(sizes) - sizes)[which], sizes[which])
        totals = np.zeros(len(lengths), np.int64)
        np.add.at(totals, np.repeat(np.arange(len(lengths)), lengths), width)
        return out, totals

    def _merged(self, units: list[str]) -> list[np.ndarray]:
        """Ids of units; the library's own ids of each that starts with a space mark must be the same."""
        lengths = np.array([len(u) for u in units], np.int64)
        flat, sizes = self._spelled(*merge_all(self.symbol_of[code_points("".join(units))].astype(np.int64), lengths, self.table))
        flat = flat.astype(np.int32)
        ends = np.cumsum(sizes).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if self.check:
            # the library puts a space mark before any text and no piece crosses into the next mark: one text holds them all
            marked = [k for k, u in enumerate(units) if u[0] == SPACE and u[-1] != SPACE]
            told = np.array(self.library.encode("".join([units[k] for k in marked])[1:]), np.int32)
            ours = gathered(flat, (np.cumsum(sizes) - sizes)[marked], sizes[marked]) if marked else told
            if not np.array_equal(ours, told):
                wrong = next((units[k] for k in marked if out[k].tolist() != self.library.encode(units[k][1:])), "a run of units")
                raise ValueError(f"agenda and library differ on {wrong!r}")
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of the texts of one sweep, each with the end id."""
        text = "".join([SPACE + t.replace(" ", SPACE) if t else "" for t in texts])
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        if not text:
            return [np.array([self.eos], np.int32) for _ in texts]
        points = code_points(text)
        place = self.place[points]
        begins = np.r_[True, ~self.joined[place[:-1], place[1:]]]
        begins[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(points)]
        first, kind = self.units.distinct(points, starts, ends)
        names = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self.memory.turn()
        new = self.memory.known(names)
        held = self.memory.young
        long = {}
        for unit, ids in zip(new, self._merged(new) if new else (), strict=True):
            if len(unit) <= SHORT:
                held[unit] = ids.tobytes()
            else:
                long[unit] = ids.tobytes()
        coded = [held[u] if len(u) <= SHORT else long[u] for u in names]
        flat = np.frombuffer(b"".join(coded), np.int32)
        width = np.array([len(c) // 4 for c in coded], np.int64)
        each = width[kind]
        ids = gathered(flat, (np.cumsum(width) - width)[kind], each)
        # a text's ids end where its last unit ends
        done = np.r_[0, np.cumsum(each)][np.searchsorted(starts, np.cumsum(sizes))].tolist()
        return [np.append(ids[a:b], np.int32(self.eos)) for a, b in zip([0, *done], done, strict=False)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text with the end id."""
        return self.encode_all([text or ""])[0].tolist()

    def decoded(self, ids: list[int]) -> bytes:
        """UTF-8 bytes of the text of ids: the first space mark goes, control ids are nothing, broken bytes are replaced."""
        data = b"".join([self.bytes_of[i] for i in ids])
        data = data[1:] if data[:1] == b" " else data
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            return data.decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        """Text of ids."""
        return self.decoded(ids).decode()

    def release(self) -> None:
        """Let go of the units that texts have brought."""
        self.memory = Remembered(REMEMBERED)

    def coded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, str]]:
        """(ids, ids_sha256, decoded_sha256) of each text of one sweep; the digests are those of the ids."""
        found = self.encode_all(texts)
        if self.check:
            # ids that the library gives and the text that it decodes them to
            k = next((k for k, t in enumerate(texts) if 0 < len(t) <= WHOLE), None)
            if k is not None and (self.library.encode(texts[k], add_eos=True) != (ids := found[k].tolist()) or self.library.decode(ids) != self.decode(ids)):
                raise ValueError(f"codec and library differ on {texts[k][:200]!r}")
        for row in found:
            ids = row.tolist()
            joined = " ".join([self.names[i] for i in ids])
            yield row, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.decoded(ids)).hexdigest()


@lru_cache(maxsize=1)
def codec(model_file: str) -> Codec:
    """The process's codec of a model file."""
    return Codec(model_file)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    """Arrow lists of ids."""
    ends = np.cumsum([0, *map(len, rows)])
    if ends[-1] >= 1 << 31:
        raise ValueError("a batch has more than 2 ** 31 ids")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def _coded(batches: Iterator[pa.Array], model_file: str, with_ids: bool) -> Iterator[pa.Array]:
    """Structs for the texts of every Arrow batch, given back sweep by sweep: neither strings nor ids of a whole batch are held."""
    own = codec(model_file)
    try:
        for batch in batches:
            for texts in array_sweeps(batch, CODED):
                rows = list(own.coded(texts))
                columns = [pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.insert(0, _lists([r[0] for r in rows]))
                    names.insert(0, "ids")
                yield pa.StructArray.from_arrays(columns, names)
    finally:
        own.release()
        give_back()


def digest_column(text: Column, model_file: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256) of every text, in Arrow batches.

    Null and empty texts are the end id alone and decode to the empty text;
    long texts are encoded whole; equal texts have equal results; an empty
    table gives no rows. It is a column, so other columns don't matter. Units
    that a task has met are let go at its end.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _coded(batches, model_file, False)

    return digest(text)


def coded_column(text: Column, model_file: str) -> Column:
    """struct(ids, n_tokens, ids_sha256, decoded_sha256) of every text, otherwise like digest_column."""

    @F.arrow_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _coded(batches, model_file, True)

    return encode(text)


def id_column(text: Column, model_file: str) -> Column:
    """array<int> of every text's ids with the end id."""
    return coded_column(text, model_file)["ids"]


def text_column(ids: Column, model_file: str) -> Column:
    """Text of every array of ids; null stays."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(model_file)
        for rows in batches:
            yield pa.array([own.decode(r.as_py()) if r.is_valid else None for r in rows], pa.string())

    return decode(ids)
