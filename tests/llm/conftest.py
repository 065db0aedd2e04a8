import random

import pytest
from pyspark.sql import types as T

#: Columns that clash with names the operators use inside.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("fp", T.StringType()), T.StructField("part", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("score", T.StringType()), T.StructField("ids", T.StringType()),
])

GOOD = "the quick brown foxes jump over lazy dogs while many calm readers walk along the green river and talk about small things"
BAD = "### $$$ %%% *** &&& ||| <<< >>> ### $$$ %%% *** &&& ||| <<< >>>"


def sentence(k: int, n: int = 60) -> str:
    """Words in an order of their own for each ``k``, hardly repeating."""
    rng, base = random.Random(k), GOOD.split()
    return " ".join(rng.choice(base) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n)) + "."


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that polynomial hashes modulo 2**64 cannot tell apart."""
    a = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks, signs only, ties, a very long text, wide signs."""
    return [None, "", " \n\t ", "x", "!!! ???", sentence(1), sentence(1), sentence(2) + " é 漢字 🙂", "word " * 30000, "A" * 70000, "a\x00b \x1c c"]


@pytest.fixture(scope="session")
def documents(spark, odd_texts):
    """``make(texts, ids=None)``: a documents table with extra columns of clashing names."""

    def make(texts, ids=None):
        rows = [(i, t, None if t is None else "en", None, None, "f", "p", "k", "s", "i") for i, t in zip(ids or range(len(texts)), texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
