"""Small tables with everything that can be odd about them."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, size string, fp string, "
    "block string, t string, words string, shard string, start string, component_id string, spans string, score string"
)
EXTRA = ["x"] * 12
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def prose(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "er", "th", "on", "re", "ti", "en", "ou", "sh", "le"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source): nulls everywhere, empty, blank, long, repeated and copied texts."""
    long = prose(1, 6000)
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b\x0c\r ", "de", "b"),
        (4, prose(2, 60) + " " + PASSAGE + " " + prose(3, 20), "en", "a"),
        (5, PASSAGE + "\n" + prose(4, 80), "en", "b"),
        (6, prose(5, 30) + "\t" + PASSAGE, None, None),
        (7, long, "fr", "hot"),
        (8, long + " more words here", "fr", "hot"),
        (9, long, "fr", "hot"),
        (10, prose(6, 40), "en", "hot"),
        (10, prose(6, 40), "en", "hot"),
        (11, "a b", "es", "é"),
        (12, "word", "es", "z"),
        (13, "Ünï cödé ñandú ß 日本 語 " * 8, "de", None),
        (14, "no no no no no no no no " * 10, "en", "a"),
        (15, "12 34 ... !!", "en", "b"),
        (None, prose(7, 50), "en", "a"),
        (None, prose(2, 60) + " " + PASSAGE + " " + prose(3, 20), None, "a"),
        (-5, PASSAGE + " tail", "en", ""),
    ]
    return rows


def table_of(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), *EXTRA) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table_of(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
