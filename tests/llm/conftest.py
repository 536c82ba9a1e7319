"""Small documents with every awkward case."""

import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + str((x >> 16) % 50))
    return " ".join(out)


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empties, odd white space, long texts, repeated rows."""
    base = prose(1, 120)
    long = prose(2, 9000)
    out = [
        (1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "one two"), (9, long), (10, long + " end"), (11, "a  b c d\n\n e \x1c f<|endoftext|> g"),
        (12, "Été ΣΣΣ 你好 \U0001f600 it's don't x1y2"), (13, "x" * 3000), (14, "dup line\ndup line\nother"), (14, "dup line\ndup line\nother"), (None, base), (None, None), (15, "you are an idiot and a moron. scum!"), (16, prose(3, 60)), (17, "A" * 10 + "\t" + "b" * 5),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def wide(docs):
    """The same with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    extra = {c: F.lit(1) for c in ("kept", "n_words", "reason", "items", "contaminated", "clauses", "score", "predicted", "size", "ids", "shingles", "cluster", "task", "doc", "row", "lp", "lang", "source")}
    return docs.withColumns(extra)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
