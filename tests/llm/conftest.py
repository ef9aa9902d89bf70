import random

import pytest

WORDS = [f"{a}{b}" for a in ("th", "er", "on", "an", "re", "ñu", "é") for b in ("ing", "ed", "tion", "ou", "a", "ß", "x")]


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", ",", ".", ".\n"]) for _ in range(n))


#: Texts that any operator must take: null, empty, blank, long runs, special strings, odd characters.
ODD = [None, "", " ", "\n\t ", "a", "x" * 5000, "word " * 3000, "<|endoftext|>", "a<|endoftext|>b", "🙂🙂 é²½٣ \x00\x01", "▁a ▁▁", " lead", "trail ", "a  b   c", "'s't 12 345", "\r\n\r\n"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, one row twice, a null id, and extra columns whose names operators use inside."""
    more = ("x", 1, b"k", "y", "z", 2, "w", True)
    rows = [(i, t, *more) for i, t in enumerate(ODD)] + [(4, "a", *more), (None, "a", *[None] * len(more))]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n int, key binary, id string, sha string, g int, predicted string, kept boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
