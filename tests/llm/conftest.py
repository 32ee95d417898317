import pytest

from quarry.llm.common import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties and repeated rows, and columns whose names operators use inside."""
    long_text = " ".join(f"word{i % 997} alpha" for i in range(20_000))
    rows = [(1, None), (2, ""), (None, "a text without an id, long enough to matter here"), (3, "same text"), (3, "same text"),
            (4, "same text"), (5, " \n\t "), (6, long_text), (7, "x" * 30_000), (None, None), (8, "é𝄞 mail a@b.org now")]
    return spark.createDataFrame([(*r, "k", 1, "s", 2.0, 3) for r in rows],
                                 "doc_id long, text string, _key string, n int, sig string, score double, _row int")
