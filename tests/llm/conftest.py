import random

import pytest
from cases import SCHEMA, docs_of


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(rng.randint(1, 120)), f"src{i % 4}") for i in range(60)]
    long_text = prose(30_000)
    rows += [(60, None, "src0"), (61, "", None), (62, " \n\t ", "src1"), (63, long_text, "src2"), (64, "x" * 200_000, None), (65, rows[3][1], "src3"), (66, rows[3][1], None)]
    rows += [rows[5], rows[5], (None, prose(40), "src1"), (None, None, None), (67, "é ü 日本   \U0001f600 " + prose(20), "ß")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return docs_of(spark, odd_rows).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
