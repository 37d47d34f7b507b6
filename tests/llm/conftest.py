"""A documents frame with the awkward rows: nulls, empty and long texts, ties, repeats."""

from __future__ import annotations

import random

import pytest

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, words: int = 800) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows() -> list[tuple]:
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", "en", "a", 4),
        (3, base, "en", "a", len(base)),
        (4, base.replace(" ", "\n", 5), "en", "b", len(base)),
        (5, base, None, "b", None),
        (5, base, None, "b", None),
        (None, base, "en", None, 1),
        (None, "one two", "en", None, 7),
        (6, prose(rng, 9000), "en", "a", 1),
        (7, "one two", "de", "c", 7),
        (8, "ünï ça 日本語  x <|endoftext|> y", "fr", "c", 9),
    ]
    for i in range(9, 60):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        text = " ".join(words) if i % 3 == 0 else prose(rng, rng.randrange(1, 300))
        rows.append((i, text, "en", "abc"[i % 3], len(text)))
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def clashing(df, *names: str):
    """``df`` with text columns named like an operator's own ones."""
    for name in names:
        if name not in df.columns:
            df = df.selectExpr("*", f"'clash' AS `{name}`")
    return df
