"""A small table of documents with every odd case, and its rows as plain Python."""

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def rows():
    rng = random.Random(5)
    base, passage = prose(rng, 300).split(" "), prose(rng, 60)
    out = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(w if i % 60 else "changed" for i, w in enumerate(base)))]
    out += [(4, " ".join(base[:270])), (5, " ".join(base[40:]) + " " + prose(rng, 30)), (6, None), (7, ""), (8, " \n\t \n"), (9, "One two Three"), (10, "one TWO three")]
    line = "  A common line of more than twenty characters\t"
    out += [(20 + i, f"{prose(rng, 40)}\n{line.upper() if i % 2 else line}\n{prose(rng, 30)} {passage} {prose(rng, 20)}\n\n") for i in range(8)]
    out += [(40, "ab " * 400), (41, "ab " * 390), (42, "x" * 5000), (43, "é ü 中文字符 <|endoftext|> it's  two　wide\r\n12,345 !!"), (44, "12 34 | 56 # 78")]
    out += [(50 + i, prose(rng, rng.randint(1, 500))) for i in range(12)] + [(90, prose(rng, 20000))]
    out += [(9, "One two Three"), (None, prose(rng, 50)), (None, prose(rng, 12)), (-3, line + "\n" + line)]
    return [(d, t, None if (d or 0) % 7 == 3 else "en" if (d or 0) % 2 else "de", None if (d or 0) % 5 == 4 else f"src{(d or 0) % 2}", len(t) if t else None) for d, t in out]


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    clash = {c: F.lit(1) for c in ("k", "node", "region", "bucket", "tail", "spans", "asked", "line", "value", "score", "lang_pred", "__drop", "__words", "n_words", "ids")}
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).withColumns(clash).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
