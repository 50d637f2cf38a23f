import pytest
from samples import SENTENCE, SF, TEXT, table


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and long texts, ties, repeated rows, an id that is null and one that repeats."""
    long = " ".join(f"word{i * i % 9973}" for i in range(30_000))
    texts = [
        (1, TEXT), (2, TEXT), (3, TEXT.replace("quiet", "still", 1)), (4, None), (5, ""), (6, " \n\t\n "), (7, "one"), (7, "one"),
        (None, "a text without an id that is long enough\nto have two lines."), (8, long), (9, "\n".join(["Home | About | Help"] * 30)),
        (10, "É ́x Σ 日本語 🙂"), (-3, TEXT + "\n" + SENTENCE), (7, "another text of the same id"), (11, "a b c d"), (12, "A  B\tC D"),
    ]
    return table(spark, texts)


@pytest.fixture(scope="session")
def nothing(edges):
    return edges.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]
