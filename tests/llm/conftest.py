import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

WORDS = "the of and river stone walks under bright morning sky with seven small boats that carry grain to market while children sing old songs about winter".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


LONG = sentence(5, 9000)
PASSAGE = sentence(77, 60)
TEXTS = [
    None, "", " \t\n", "A", "a", "One Two", "one two", sentence(1, 40), sentence(1, 40).upper(), sentence(1, 40), sentence(2, 60) + " " + PASSAGE, PASSAGE + " " + sentence(3, 50), sentence(4, 20) + "\n" + PASSAGE + "\n" + PASSAGE, LONG, LONG + " tail", "é" * 70 + " ünï " * 30, "é" * 70 + " ünï " * 31, "日本語のテキスト　です。" * 12, "$$$ *** ### " * 40, "x" * 3000, "same line here\n" * 12, "🙂 👍🏽 <|endoftext|> it's  spaced   out ▁ mark " * 3, "\x00nul\x1c byte", sentence(6, 12),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Null, empty, blank, very long and odd texts, copies, shared passages, a repeated row, a null id and host, and a clashing column."""
    rows = [(i, t, "en" if i % 3 else "de", None if i == 4 else f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    rows += [rows[7], (None, sentence(9, 30), None, "src0", 1), (None, sentence(1, 40), "en", "src1", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({"key": F.lit("mine"), "group": F.lit(3), "print": F.lit(1), "length": F.lit("x"), "id": F.lit(0)})


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
