import pandas as pd
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = "Long words follow each other. " * 4000


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, with further columns whose names clash."""

    def build(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("kept", "score", "row_no", "node", "block", "tokens", "mix_pass", "ids", "start", "_text", "label"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, repeated rows, ties, odd characters."""
    return [(1, "one two three four five six seven"), (2, None), (3, ""), (4, LONG), (4, LONG), (5, "one two three four five six seven"),
            (None, "a null id here"), (6, " "), (7, "tab\tand\n\nlines  and <|endoftext|> marks"), (8, "é ü ñ   　 漢字"),
            (9, "a"), (10, "A b\0c d"), (11, ""), (3, "same id, other text")]


def frame(df):
    return pd.DataFrame(df.collect(), columns=df.columns)


@pytest.fixture(scope="session")
def rows():
    return frame


@pytest.fixture(scope="session")
def documents(data):
    d = pd.read_parquet(f"{data}/documents.parquet").sort_values("doc_id").reset_index(drop=True)
    d["text"] = d.text.fillna("")
    return d
