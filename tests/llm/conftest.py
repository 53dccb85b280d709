import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, digest string, size int, fp string, list int, `__id` string, norm double"


def hard_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, shared passages, odd characters."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(70)
    texts = [None, "", " \t\n", "one", "one  two", "x" * 40_000, prose(9_000), "日本語 🎉 naïve ▁ <|endoftext|> \u0085 \x1c end", "a\x00b\n\nc  d", "word. Word, word!\nNext line"]
    texts += [prose(rng.randint(3, 120)) for _ in range(25)]
    base = prose(90)
    texts += [base] * 6 + [base.replace(" ", "\n", 1), base + " ", " " + base + "  "]
    texts += [base + " tail", base.upper(), base.replace("a", "b", 1)]
    texts += [prose(8) + " " + passage + " " + prose(8) for _ in range(5)]
    texts += [passage * 2, passage[3:230], passage[:199], passage[:200], passage[:200]]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["s1", "s1", "s1", "s2", "s10", None]), len(t or ""), "k", None, 1, "f", None, "i", None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[20], rows[20], (None, "null id", None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None), (7, "the same id again", "en", "s2", 1, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), KIND).repartition(5)


@pytest.fixture(scope="session")
def hard_list():
    return [(r[0], r[1], r[3]) for r in hard_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 3 and 1, int(i % 7 == 0)) for i in range(70)] + [(3, None, None), (None, 1, 1), (4, 0, 1), (10_000, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
