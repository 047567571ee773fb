import random

import pytest

#: Names that operators use for themselves.
CLASHING = (
    "score lang_pred labels shard depth bytes fp fold nth tag spans seed at h u v key kept first row own own_tag id id_tag n_words n_removed kept_text ids decoded place total special piece "
    "_n _first _leaked _h _id _shard _key text_ predicted evidence covered_words similarity item_id"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    long_text = " ".join(f"word{i % 977} tail{i}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t\x0b ", "en", "a", 5), (4, "!!! 123 ???", None, "a", 11), (5, "word", "en", "a", 4), (5, "word", "en", "a", 4),
        (6, long_text, "en", "hot", len(long_text)), (7, "x" * 300_000, None, "hot", 300_000), (None, "a text without an id, in plain words", "en", "hot", 36), (8, "word", "fr", "b", 4),
        (5, "another text under the same id", "de", "b", 30), (9, "漢字 and émojis 😀 <|endoftext|> end", None, "b", 30),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """300 invented texts with copies, near copies, shared passages and leaks."""
    r = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passages = [text(70) for _ in range(4)]
    rows = []
    for i in range(300):
        t = text(r.choice([3, 20, 60, 150, 400]))
        if i % 10 == 3 and rows:
            t = r.choice(rows)[1]
        elif i % 10 == 5 and rows:
            w = r.choice(rows)[1].split()
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 10 == 7:
            t = f"{text(r.randrange(40))} {r.choice(passages)}\n{text(r.randrange(40))}"
        rows.append((i, t, "en", "s", len(t)))
    return spark.createDataFrame(rows, SCHEMA)
