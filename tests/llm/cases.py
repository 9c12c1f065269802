"""Small tables with the awkward cases every training-data operator must handle."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, score string"


def prose(seed: int, n: int, lang: str = "en") -> str:
    r = random.Random(seed)
    parts = {"en": ["the", "of", "th", "ing", "er", "wh", "and"], "fr": ["le", "eau", "é", "que", "oi", "ment"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward_rows() -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties, repeated rows, copies, clashing columns."""
    shared = prose(99, 120)
    long = prose(5, 30_000)
    texts = [
        (0, prose(0, 200), "en"), (1, prose(1, 200, "fr"), "fr"), (2, prose(0, 200), "en"),
        (3, shared + " " + prose(3, 80), "en"), (4, prose(4, 70) + " " + shared, None),
        (5, long, "en"), (6, None, "en"), (7, "", "fr"), (8, "   \n\t ", "fr"), (9, "1234 5678 !!", "en"),
        (10, "Word", "en"), (11, long[:400], "en"), (12, prose(12, 90) + "\n" + shared[:300] + "\n" + prose(13, 9), "en"),
        (None, prose(1, 200, "fr"), "fr"), (None, None, None), (13, "a b", "en"), (13, "a  b", "en"),
        (14, "é" * 500, "fr"), (14, "é" * 500, "fr"), (15, "日本語 テキスト" * 40, "en"),
        (16, "x" * 3000, "en"), (17, prose(17, 150, "fr"), "fr"), (18, prose(17, 150, "fr") + " fin", "fr"),
    ]
    return [(i, t, lang, None if i == 3 else "s", None if t is None else len(t), "k", 1, "s") for i, t, lang in texts]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text) -> list[bytes]:
    return (text or "").encode().split()
