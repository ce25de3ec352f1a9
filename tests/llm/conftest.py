import pytest

EXTRA = "doc_id long, text string, lang string, key string, words string, n_shingles int, n_removed string"


@pytest.fixture
def frame(spark):
    """Documents with further columns, some of which share names with the operators' own."""

    def make(rows, parts=3):
        return spark.createDataFrame([(d, t, "en", "k", "w", 7, "r") for d, t in rows], EXTRA).repartition(parts)

    return make


#: Nulls, empty and odd texts, repeats; next to whatever a test is about.
ODD = [(9001, None), (9002, ""), (9003, " \n\t\n"), (9004, "x"), (9005, "x"), (9006, "\x1c \x85 word"), (None, "a row without an id but with a few words in it")]
