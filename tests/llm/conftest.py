import random

import pytest

SF = "/root/testdata/sf0.001"
#: Columns of documents, and extra ones whose names the operators use inside.
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, draw double, labels string, print binary, score double, class_id long, rows int, n long, kept boolean"


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The tables here are small: fewer tasks a shuffle, and tests take half the time."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def document(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), 7, 0.5, "x", b"x", 0.1, 3, 4, 5, True)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ties."""
    rng = random.Random(2)
    long = " ".join(rng.choice(["the", "of", "Alpha,", "beta.", "gamma", "größe"]) + ("\n" if rng.random() < 0.05 else "") for _ in range(60_000))
    texts = ["", " \n\t ", "one", "one two three four", "a\x0bb\x0cc\x1cd e", "▁ x  ▁▁", "\U0001f600 é é İ J̌ ß", "x" * 5000, "<|endoftext|> hi", "All rights reserved.", "\n\n\n"]
    rows = [document(i, t, "s" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [document(100, None), document(None, "null id text here"), document(None, None, None), document(101, long, "big"), document(102, long, "big"), document(3, "one two three four"), document(3, "another text with the same id")]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
