import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Words that differ between the texts below, so that no two of them are alike by chance.
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "to", "vi") for c in ("b", "d", "f", "g", "k")]


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7919 + i * i * 31 + i * seed) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, ties, non-ASCII, a very long text."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, prose(5, 60)), (6, prose(5, 60)), (6, prose(5, 60)), (7, prose(7, 80).upper()), (8, prose(7, 80)),
        (9, "Ünïcödé wörds äre wörds, tóo — 東京 🙂"), (10, "x" * 50_000), (11, prose(11, 40_000)), (None, prose(12, 50)), (12, prose(5, 60) + " tail"),
    ]


@pytest.fixture
def edge(spark, edge_rows):
    """The edge rows, with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in edge_rows], SCHEMA)
    return df.withColumns({c: F.lit(7) for c in ("fp", "rep", "row", "key", "kind", "component_id", "html", "digest")}).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
