"""Small tables with awkward rows, shared by the operator tests."""

import random

SCHEMA = "doc_id long, text string, h string, key long, spans string"  # clashing extra columns


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward(spark, texts):
    rows = [(i, t, "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    """Null, empty, blank, very long, non-Latin, repeated."""
    rng = random.Random(5)
    long_one = words(rng, 30_000)
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, long_one), (5, "日本語 テキスト é ñ ß \U0001f44d"),
        (6, "same text here"), (7, "same text here"), (8, "a" * 5000), (9, "one"), (10, "x  y \n z  "),
    ]


def as_dict(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
