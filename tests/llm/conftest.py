from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from planar.llm.ship import ship_code

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    """A-Z only."""
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# Names that operators use inside, to clash with.
CLASHES = ("n_words", "size", "bucket", "key", "words", "counts", "doc", "t", "label", "node", "kept", "grp", "h", "spans")


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long, shared = prose(30_000), prose(40)
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b\x0c\r ", None), (4, "one", None), (5, "one", ""), (6, long, "b"),
        (7, long + " tail", "b"), (8, shared, "a"), (8, shared, "a"), (9, "start " + shared, "a"),
        (10, shared.upper(), "z"), (11, "é ü ß 漢字 " * 9, "a"), (12, "a b c d", "a"), (13, "a  b\nc d", "a"),
        (None, shared, "a"), (None, None, None), (14, "x" * 20_000, "a"), (15, "again and " * 30, "é"), (16, "nul \x00 byte", "a"),
        (-5, shared + " more", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, "doc_id bigint, text string, source string")
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES]).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
