import random

import pytest
from pyspark.sql import functions as F

# Names that the operators use inside; a table may have them too.
CLASHING = (
    "id", "size", "n", "h", "doc", "bucket", "token", "words", "lines", "span", "g", "tree", "node", "at", "taken", "copies", "word",
    "text_hash", "component", "class_id", "marks", "target", "shard", "file", "part", "key", "s", "d", "p", "bad_id", "prefix", "c",
)


def table(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    frame = spark.createDataFrame(rows, schema).repartition(3)
    return frame.withColumns({name: F.lit("x") for name in CLASHING if name not in frame.columns})


@pytest.fixture(scope="session")
def words():
    rng = random.Random(11)
    return ["".join(rng.choice("abcdeinorstü") for _ in range(rng.randrange(1, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def messy_rows(words):
    """Copies, near copies, repeated rows, nulls in every column, empty, blank and long texts."""
    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n)) + "."
    rows = []
    for k in range(40):
        text = prose(rng.randrange(1, 150))
        rows.append((k, text, rng.choice(["en", "de", None]), rng.choice(["b", "a", None]), len(text)))
    for k in range(40, 60):  # near copies, some of them exact
        near = rows[k % 4 + 2][1].split(" ")
        for _ in range(k % 3):
            near[rng.randrange(len(near))] = "edit"
        rows.append((k, " ".join(near), "en", "a", None))
    long = prose(30_000)
    rows += [
        (60, None, "en", "a", None), (61, "", None, "b", 0), (62, " \n\t ", "de", None, 3), (63, long, "en", "a", len(long)),
        (64, "Unbroken" * 20_000, None, None, None), (None, prose(80), "en", "a", 5), (None, None, None, None, None),
        rows[3], rows[3], (65, "é漢字😀 <s> | ▁  two  blanks\r\n\x00 don't", "fr", "c", 1), (66, rows[7][1].upper(), "en", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return table(spark, messy_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])
