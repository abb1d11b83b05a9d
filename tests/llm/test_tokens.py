import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import piece_codec, token_transducer
from tessera.llm.common import tokenizer_file

PIECES, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")


def texts(seed, n=400):
    rng = random.Random(seed)
    letters = [*" \n\t\x1c\x85 ​aeiothnrs.,'é日ж\x00🙂-0159²Ⅷ▁", "<|endoftext|>", "'s", "'ll", "  ", "</s>"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 70))) for _ in range(n)] + ["", " ", "x" * 500, "ab " * 200, " " * 90 + "z", "\n\n"]


def test_ids_and_round_trip_equal_the_library():
    own = piece_codec.Codec(PIECES)
    for t in texts(1):
        ids = own.library.encode(t, add_eos=True)
        assert own.encode(t) == ids
        assert own.decode(ids) == own.library.decode(ids)


def test_the_check_against_the_library_raises():
    own = piece_codec.Codec(PIECES)
    own.table.rank = own.table.rank.max() - own.table.rank
    with pytest.raises(ValueError, match="differ"):
        own.encode("ererhation unwhbleing thshantion ordinarythereof")


def test_codec_columns(documents):
    own = piece_codec.codec(PIECES)
    ids = piece_codec.id_column(F.col("text"), PIECES)
    rows = documents.select("text", piece_codec.digest_column(F.col("text"), PIECES).alias("d"), ids.alias("i"), piece_codec.text_column(ids, PIECES).alias("t")).collect()
    for r in rows:
        want = own.library.encode(r.text or "", add_eos=True)
        assert list(r.i) == want and r.d.n_tokens == len(want)
        assert r.d.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.t == own.library.decode(want) and r.d.decoded_sha256 == hashlib.sha256(r.t.encode()).hexdigest()


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    own, lib = token_transducer.Transducer(BYTES), Tokenizer.from_file(BYTES)
    for t in texts(2):
        assert own.counts([t]) == [len(lib.encode(t, add_special_tokens=False).ids)]


@pytest.mark.parametrize("chunk", [1, 3, 8, 31])
def test_counts_do_not_depend_on_chunks(chunk):
    own = token_transducer.Transducer(BYTES)
    many = texts(3, 150)
    assert own.counts(many, chunk) == own.counts(many)


def test_prefix_scan_is_that_of_the_machine():
    own = token_transducer.PretokenMachine()
    rng = np.random.default_rng(4)
    kinds = rng.integers(0, token_transducer.RESET + 1, 300)
    scanned = own.scan(own.letter[kinds])
    states = np.arange(len(own.step))
    for k, prefix in zip(kinds, scanned, strict=True):
        states = own.step[states, k]
        assert (own.to[prefix] == states).all()


def test_pretokens_are_those_of_the_pattern():
    import regex

    own = token_transducer.PretokenMachine()
    for t in texts(5, 800):
        kinds = np.append(own.classes[token_transducer.code_points(t)], np.uint8(token_transducer.RESET))
        starts = [i for i in np.flatnonzero(own.begins_at(kinds, 7)) if i < len(t)]
        assert starts == [m.start() for m in regex.finditer(token_transducer.SPLIT, t)]


def test_counting_machine_on_runs_and_after_forgetting(monkeypatch):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    monkeypatch.setattr(token_transducer, "STATES", 40)
    own = token_transducer.Transducer(BYTES)
    rng = random.Random(9)
    runs = ["".join(rng.choice("aeht-= nsing") * rng.randint(1, 9) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    assert own.counts(runs) == [len(lib.encode(t, add_special_tokens=False).ids) for t in runs]
    assert len(own.counting.configurations) <= 40 + 100


def test_units_with_one_rolling_hash_are_told_apart():
    # a word and its letters exchanged agree in every polynomial modulo 2 ** 64
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    points = token_transducer.code_points(word + word.translate(str.maketrans("ab", "ba")) + word)
    n = len(word)
    first, kind = token_transducer.Units().distinct(points, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert first.tolist() == [0, 1] and kind.tolist() == [0, 1, 0]


def test_count_column_takes_nulls(documents, empty):
    rows = documents.select("text", token_transducer.count_column(F.col("text"), BYTES).alias("n")).collect()
    assert all(r.n == 0 for r in rows if not r.text) and all(r.n > 0 for r in rows if r.text)
    assert empty.select(token_transducer.count_column(F.col("text"), BYTES)).count() == 0
