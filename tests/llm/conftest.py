import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, key string, component long, score double, rank int, bucket int, length int, row int, n int, label int, word string, line string, _key long, _id long, _text string, _y int"
BASE = "The quick brown fox jumps over the lazy dog while seven wizards box quietly behind the old stone mill near the river. "


def row(key, text, lang="en"):
    return (key, text, lang, "s", None if text is None else len(text), 1, 2, "k", 3, 0.5, 1, 1, 7, 1, 1, 0, "w", "l", 5, 6, "t", 1)


LONG = " ".join(f"word{i % 977} other{i % 13}." for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, repeated rows, a null id."""
    return [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, BASE * 3), row(4, BASE * 3), row(5, BASE * 3), row(6, LONG, None), row(7, "???"), row(8, "one"), row(9, "one two"),
        row(10, "Ein kurzer Satz über Häuser.\nEin kurzer Satz über Häuser.", "de"), row(None, BASE * 3), row(11, "日本語のテキスト 😀  x", "ja"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
