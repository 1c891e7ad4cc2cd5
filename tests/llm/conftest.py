import pytest

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in old trees near cold clear water".split()


def text(seed, n):
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15] + chr(97 + (x >> 12 & 15)) * (x >> 16 & 1) + ("." if x >> 20 & 7 == 0 else ""))
    return " ".join(out)


def rows():
    base = text(1, 120)
    near = base.replace("fox", "cat", 1)
    shared = text(2, 40)
    return [
        (1, base, "en", "b"), (2, base, "en", "a"), (3, near, "en", None), (4, None, "en", "a"), (5, "", None, "a"), (6, " \t\n ", "en", "b"),
        (7, text(3, 60) + "\n" + shared + "\n" + text(4, 50), "en", "c"), (8, text(5, 30) + "\n" + shared, "de", "c"), (9, "one two", "en", "c"), (10, "one  two", "en", "c"),
        (11, "éü 你好 \U0001f600 " + text(6, 30), "fr", "a"), (12, text(7, 6000), "en", "a"), (13, "ab " * 200, "en", "b"), (20, text(8, 20), "en", "b"), (20, text(8, 20), "en", "b"),
        (40, text(9, 80).upper() + "\n\n" + text(9, 80), "en", "d"),
    ]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, a repeated row, and columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 5, "x") for r in rows()], "doc_id long, text string, lang string, source string, n_chars long, n long, key string").cache()


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
