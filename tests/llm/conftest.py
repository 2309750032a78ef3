import random

import pytest

#: Extra columns have the names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, fp long, bucket int, size long, score double, h long"


def make_texts() -> list[tuple[int | None, str | None, str | None, str | None]]:
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows and ids, copies and near copies."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows: list = [(i, text(rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(60)]
    long = text(6000)
    rows += [(100, long, "en", "a"), (101, long, "en", "b"), (102, long.replace("a", "é", 3), "de", "b")]
    rows += [(103, None, "en", "a"), (104, "", None, None), (105, " \t\n", "en", "c"), (106, "1234 !!", "en", "c"), (107, "x", "en", "c")]
    rows += [(108, rows[3][1], "en", "a")] * 3 + [(109, "same id", "en", "a"), (109, "other text", "en", "a"), (None, "no id", None, "b"), (None, "no id", None, "b"), (None, rows[5][1], "en", None)]
    rows += [(110, "日本語のテキスト 😀 " * 40, "en", "c"), (111, "a" * 2500, "en", "c"), (112, "Ab aB ab " * 300, "de", "c")]
    return rows


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 3, 4, 5, 0.5, 6) for i, t, lang, s in texts], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
