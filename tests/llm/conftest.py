import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(FOLDER):
        pytest.skip("test tables absent")
    return FOLDER


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and blank texts, one word, ties, repeated rows, copies, near copies, a long text, rare characters."""
    pick = random.Random(5)
    vocabulary = ["".join(pick.choice("abcdeéßŁ日🙂") for _ in range(pick.randrange(1, 7))) for _ in range(300)]
    sentence = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    base = "\n".join(sentence(30) for _ in range(6))

    def edited(text, n):
        w = text.split(" ")
        for _ in range(n):
            w[pick.randrange(len(w))] = pick.choice(vocabulary)
        return " ".join(w)

    rows = [(1, None), (2, ""), (3, "  \n\t\n"), (4, "word"), (5, "one two three four"), (None, base), (6, base), (6, base), (7, base.upper()), (8, None)]
    rows += [(10 + k, edited(base, 1 + k % 9)) for k in range(40)]
    rows += [(60 + k, sentence(40) + "\n" + base.split("\n")[0] + "\n\n" + sentence(25)) for k in range(20)]
    rows += [(90, sentence(25) + " " + "again and again this runs on " * 12), (91, "x " * 100), (92, sentence(20000)), (93, "a\r\nb\nc\x0bd" * 30)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with columns whose names operators might use themselves."""
    rows = [(i, t, "en", k, b"x", [1], 0.5) for k, (i, t) in enumerate(odd_rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, digest binary, bands array<int>, _text double").repartition(3).cache()
