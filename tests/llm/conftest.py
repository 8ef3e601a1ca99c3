import random

import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with a column whose name clashes with the operators' own."""

    def make(texts, first=0):
        rows = [(first + k, t, "en", f"s{k % 3}", None if t is None else len(t), f"x{k}") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string")

    return make


@pytest.fixture
def prose():
    """Random sentences; seeded."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(800)]

    def make(n, seed=0):
        r = random.Random(seed)
        out = []
        while len(out) < n:
            s = [r.choice(words) for _ in range(min(r.randint(4, 9), n - len(out)))]
            s[-1] += "."
            out += s
        return " ".join(out)

    return make


#: Nulls, blanks, ties, long texts, odd characters.
ODD = [None, "", " \t\n", "a", "A a", "...", "K\u0130\u212a", "caf\u00e9 \U0001f600 x\x0by\u00a0z", "w " * 30_000, "same text here", "same text here"]


@pytest.fixture
def odd(docs_of):
    from pyspark.sql import functions as F

    df = docs_of(ODD)
    nulls = df.limit(2).select(F.lit(None).cast("long").alias("doc_id"), F.lit("no id").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("n_chars"), F.lit(None).cast("string").alias("key"))
    return df.unionByName(nulls).unionByName(df.where("doc_id = 9"))
