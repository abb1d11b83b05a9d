"""Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pytest

from tessera.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def scratch(spark):
    return Scratch(spark)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def rows(words):
    """About 120 rows with exact and near copies and all awkward cases."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), "  " + texts[1] + "\n", texts[2].replace(" ", "\t")]
    base = texts[3:13]
    for t in base:
        for _ in range(3):
            parts = t.split(" ")
            if len(parts) > 8:
                parts[rng.randrange(len(parts))] = rng.choice(words)
            texts.append(" ".join(parts))
    texts += ["", "   ", None, None, "one two three", "ONE two  three", "é日本 ß " * 30, "x" * 3000, " ".join(words * 12)]
    out = [(i * 3 + 1, t, "en", f"src{i % 3}" if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], out[5], (None, "text without id", "en", "src0", 15)]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
