import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    vocabulary = [a + b for a in ("ka", "lo", "mi", "te", "ru", "sa") for b in ("n", "ra", "st", "vel", "ing", "o", "é", "ß")]
    return " ".join(rng.choice(vocabulary) + ("." if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, shared passages."""
    rng = random.Random(3)
    passage, long = prose(rng, 30), prose(rng, 30_000)
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    texts += [f"{prose(rng, 20)} {passage} {prose(rng, 20)}" for _ in range(10)]
    texts += [texts[3]] * 5 + [texts[4].replace(" ", "\n")] * 2 + ["  " + texts[5] + "\t\x0b"] * 2
    texts += ["", None, " \t\n", "one", "one two", "ONE two", "x" * 5000, long, long, texts[7] + " tail", None, ""]
    made = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", "", None, "ü"]), None if t is None else len(t)) for i, t in enumerate(texts)]
    made += [made[3], made[3], (None, texts[8], "en", "a", 3), (None, None, None, None, None), (None, texts[8], "en", "a", 3)]
    rng.shuffle(made)
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    clash = ["chunk", "bucket", "size", "before", "path", "crc", "hash", "fp", "root", "length", "count", "_row", "_id", "label"]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, F.col("lang")).withColumns({c: F.lit("x") for c in clash}).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 7 != 0), int(i % 4 == 0)) for i in range(80)] + [(3, None, None), (None, 1, 1), (4, 0, 0), (5, 9, 9)],
        "doc_id long, quality int, toxic int")
