import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in every column, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(20)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    out = []
    for k in range(120):
        out.append([k, words(rng, rng.randint(1, 120), vocab), "ab"[k % 2], f"s{k % 5}", k])
    for k in range(0, 30, 3):                                   # exact and near copies
        out.append([200 + k, out[k][1], "a", "s0", 1])
        out.append([300 + k, out[k][1] + " tail", "a", "s0", 1])
    passage = words(rng, 40, vocab)                             # one passage in many documents
    for k in range(400, 420):
        out.append([k, words(rng, 30, vocab) + "\n" + passage + "\n" + words(rng, 20, vocab), "b", "hot", 1])
    out.append([500, words(rng, 30_000, vocab), "a", "hot", 1])  # very long
    out.append([501, "", "a", "s1", 0])
    out.append([502, None, None, None, None])
    out.append([503, " \n\t ", "b", None, 3])
    out.append([504, "é ü \U0001f600 tokén=abcdefgh über", "b", "s2", 3])
    out.append([None, out[3][1], "a", "s3", 4])
    out.append([None, None, None, None, None])
    out += [list(out[5]), list(out[5])]                         # repeated rows
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The same documents with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "row", "res", "name", "key", "text_sha256", "kept", "fp", "component_id", "tokens", "epoch",
              "weight", "spans", "rep", "sha", "tree", "score", "kinds", "body", "part", "label", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df
