import random

import pytest

CLASHES = "score double, held_out boolean, predicted int, fp long, key long, component_id long, size long, copies long, taken long, line int, h1 long, leaf long, t string, g long, p double, u double, id long, y int, cell long, a long, b long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def prose(seed, n, words="the of and ing tion ther an re on er in at es ed nd to or ea ti ar".split()):
    """Invented words of one to three syllables."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def doc_rows(rows):
    """(doc_id, text, lang, source) with values in columns whose names clash with those used inside."""
    return [(i, t, lang, s, len(t or ""), *[None] * (CLASHES.count(",") + 1)) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ids that repeat with other texts."""
    long = prose(1, 20_000)
    rows = [
        (None, None, None, None), (None, "a null id", "en", None), (1, None, None, "s"), (2, "", "en", "s"), (3, " \n\t ", "en", ""), (4, long, "en", "s"), (5, long, "en", "t"),
        (6, prose(2, 80), "fr", "s"), (6, prose(2, 80), "fr", "s"), (6, prose(3, 80), "fr", "s"), (7, "ÀÉ 漢字 \x00 ", "xx", "t"), (8, "12 34", None, "t"), (9, "x" * 50_000, "de", "t"),
    ]
    return spark.createDataFrame(doc_rows(rows), DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(4, 9)] + [(None, 1, 1), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def tables(spark, sf_dir):
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "pages", "benchmark")}
