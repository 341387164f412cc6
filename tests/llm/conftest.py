import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, anchors string, spans string, keep int"


def sentence(rng, letters, words):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    rng = random.Random(1)
    text = sentence(rng, "abcdefgh", 60)
    rows = [
        (1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "   \n\t ", "en", "s", 6),
        (5, text + " tail", None, "s", len(text) + 5), (6, sentence(rng, "abcdefghij", 20_000), "en", "hot", None), (None, "no id here at all", "en", "s", 17), (7, "x", "en", "s", 1),
        (8, "漢字かな交じり文 and words", "ja", "s", 18), (9, "\x00 nul \u2028 line 😀", "en", "s", 16),
    ]
    return spark.createDataFrame([(*r, 0.5, "fp", "a", "s", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
