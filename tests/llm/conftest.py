import pytest

WORDS = "the ion of ander re st with hain on edthe tion é ñas über 12 7,5 it's !! 日本".split()


def text(k: int, n: int) -> str:
    return " ".join(WORDS[(k * 7 + i * i * (k % 5 + 1) + i) % len(WORDS)] + ("\n" if i % 11 == 10 else "") for i in range(n)).replace("\n ", "\n")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null, empty, very long, tied and repeated rows, and columns whose names an operator might use itself."""
    rows = [(k, text(k, 5 + k * 3), "x", k) for k in range(40)]
    rows += [(100, None, "x", 1), (101, "", None, 2), (102, "   \n\n ", "x", None), (103, text(3, 30_000), "x", 0), (104, "a" * 70_000, "x", 0), (7, text(7, 26), "x", 7), (7, text(7, 26), "x", 7), (None, "no id here", "x", 9), (105, "two  spaces\tand <|endoftext|> \x1c kept", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, row long")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
