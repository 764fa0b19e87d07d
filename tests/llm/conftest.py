import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

EN = "The river rose in the night and by the morning the lower fields were under water again. "
DE = "Der Fluss stieg in der Nacht und am Morgen standen die unteren Felder wieder unter Wasser. "
FR = "La rivière monta dans la nuit et au matin les champs du bas étaient encore sous les eaux. "

ODD = [
    (1, EN + "It thawed.\nAnd then it froze.", "en", "a", 10),
    (2, EN + "It thawed.\nAnd then it froze.", "en", "a", 10),
    (3, DE + DE + "\n\nUnd dann fror es.", "de", "b", None),
    (4, None, "en", "a", None),
    (5, "", None, None, 0),
    (6, " \n\t ", "fr", "b", 4),
    (7, FR * 3 + "<|endoftext|> it's 12 \U0001f600 é", "fr", "c", None),
    (8, "x", None, "c", 1),
    (9, (EN + DE) * 400, "en", "a", None),
    (10, "a" * 5000, None, None, None),
    (None, "no id here", "en", "b", None),
    (11, EN + "It thawed!\nAnd then it froze.", "en", None, 3),
    (11, EN + "It thawed!\nAnd then it froze.", "en", None, 3),
]

#: Names that the operators give to their own columns.
CLASHING = ["id", "size", "key", "row", "fp", "slot", "shard", "bin", "rank", "score", "_row", "_again", "_lang", "_keep", "keep", "part", "next", "u", "copies", "lang_pred", "v", "block"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and long texts, repeated rows."""
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(odd):
    """The same with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    return odd.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
