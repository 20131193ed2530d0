import pytest

from postingworks.llm.registry import prepared

CLASHING = "length int, start string, id long, class string, n long, key string, block int, words string, _doc int, spans int"


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


@pytest.fixture
def documents(spark):
    """A table of documents from texts; `clashing` adds columns named like what the operators use inside."""
    def build(texts, clashing=False, parts=3):
        rows = [(i, t, "en" if i % 2 else "de", "src", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        if clashing:
            for column in CLASHING.split(", "):
                name, kind = column.split()
                df = df.selectExpr("*", f"CAST(7 AS {kind}) AS `{name}`")
        return df.repartition(parts)
    return build


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
