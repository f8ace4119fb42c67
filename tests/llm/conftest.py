import random

import pytest

from tests.conftest import SF_MID, SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["d", "t", "h", "p", "fp", "tag", "row", "raw", "kept", "size", "shard", "stats", "g", "x0", "m0", "n", "first", "lost", "_row"]


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def middle(spark):
    return spark.read.parquet(f"{SF_MID}/documents.parquet")


def awkward_rows():
    """Nulls, empty and blank texts, ties, near copies, odd characters, long texts and lines."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 7)))
    para = lambda n: " ".join(word() for _ in range(n))
    shared, base = para(120), para(60)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, "a"), (4, "one", "en", None),
        (5, "Same text here", "en", "b"), (6, "Same text here", "en", "b"), (7, "Same text here", None, None),
        (8, "İstanbul x  y z 123٣ ²½ it's we'LL \U0001f600\U0001f600 <|endoftext|>\r\n\n  end  ", "de", "c"),
        (9, "a" * 3000, "en", "a"), (10, "ab" * 900 + " tail", "en", "a"), (11, "\n" * 50, "en", "a"),
        (12, para(9000), "fr", "c"), (13, para(200) + "\n" + shared + "\n" + para(200), "en", "a"),
        (14, shared + "\n" + para(30), "en", "c"), (15, para(10) + " " + shared + " " + para(10), "en", "a"),
        (16, "  SHARED line of text  \nown " + para(3), "en", "a"), (17, "shared LINE of text\nshared line of text\nx", "en", "a"),
        (18, "été à É\nétéàéxyzwü\n", "fr", "a"), (19, "étéàéxyzwü\nétéàéxyzw", "fr", "a"),
        (20, "word " * 40, "en", "a"),
    ]
    for i in range(30):  # near copies: one word changed
        w = base.split()
        w[rng.randrange(60)] = word()
        rows.append((100 + i, " ".join(w), "en", "a"))
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward rows with columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(d, t, la, s, len(t or "")) for d, t, la, s in awkward_rows()], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="session")
def repeated(spark):
    """Rows repeated as a whole, and rows without an id."""
    text = "some words that come again and again in this little text of ours"
    rows = [(1, text, "en", "a", 1)] * 3 + [(2, text, "en", "a", 1), (None, text, "en", "a", 1), (None, "other words", None, None, 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
