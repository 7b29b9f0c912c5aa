import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
CLASHING = ["n", "key", "score", "words", "rid", "places", "_w", "shard", "part", "h"]


def words(rng: random.Random, n: int, of: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghij") for _ in range(2 + k % 5)) + str(k) for k in (rng.randrange(of) for _ in range(n))]


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, very long ones, repeats, near copies at the threshold, odd characters."""
    rng = random.Random(5)
    base = words(rng, 60)
    out = [None, "", " \n\t ", "one", "one two three", "Ünï çödé 日本語 テスト 😀", "a  b   c\n\n d \n e", "x" * 30_000, " ".join(words(rng, 6000))]
    out += [" ".join(base)] * 3
    for k in (1, 2, 3, 5, 8, 12):
        some = list(base)
        for _ in range(k):
            some[rng.randrange(len(some))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(some))
        out.append(" ".join(base[k:]))
    for n in range(1, 14):
        w = words(rng, n)
        out += [" ".join(w), " ".join(w[:-1]), " ".join([*w, "tail"]), " ".join(w).upper()]
    passage = " ".join(words(rng, 55))
    out += [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 70)) for _ in range(12)]
    out += ["the same line\nthe same line\nanother\nthe same line", "###$$$ a &b <c> |d| " * 30, "A b c A b c A b c", "<|endoftext|> x <|endoftext|>"]
    return out


@pytest.fixture
def documents(spark, odd_texts):
    rows = [(k, t, "en" if k % 3 else None, f"src{k % 4}", None if t is None else len(t)) for k, t in enumerate(odd_texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(documents):
    from pyspark.sql import functions as F

    return documents.select("*", *[F.lit(1).cast(IntegerType()).alias(c) for c in CLASHING])
