import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from texts, or from (doc_id, text, lang) rows; extra columns have names that operators use."""
    from pyspark.sql import functions as F

    from eigenspark.llm.common import ship

    ship(spark)

    def run(rows, clash=False):
        rows = [(i, r, "en") if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, g, "s", None if t is None else len(t)) for i, t, g in rows], DOCS).repartition(3)
        if clash:
            for c in ("score", "features", "runs", "row", "packed", "bands", "n", "label", "lang_pred", "h1", "id", "bin", "spans"):
                df = df.withColumn(c, F.lit(c))
        return df

    return run


def words(rng, n, size=3000):
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


@pytest.fixture(scope="session")
def random_words():
    return words
