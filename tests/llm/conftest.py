import pytest

#: Columns whose names the operators use inside.
CLASHING = "uid string, `uids` int, `_uid` int, sig int, pos int, seg int, keep_id string, root int, `key` string, `src` int, cdf string, times int, copy int, `v` string, `h` int, predicted string, `a.b` int"


@pytest.fixture(scope="session")
def table(spark):
    """Documents with nulls in any column, empty and very long texts, ties, repeated rows, and columns with clashing names."""

    def make(rows, ids="bigint"):
        base = f"doc_id {ids}, text string, lang string, source string, n_chars bigint"
        extra = (None, 1, None, None, None, None, "k", None, None, None, None, None, None, None, None, None, None)
        return spark.createDataFrame([(*r, *extra) for r in rows], f"{base}, {CLASHING}")

    return make


LONG = " ".join(f"wort{i % 997}x{i}" for i in range(120_000))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars)."""
    return [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43), (2, "The quick brown fox jumps over the lazy dog", "en", "b", 43), (2, "The quick brown fox jumps over the lazy dog", "en", "b", 43),
        (3, "", "en", "a", 0), (4, "", None, None, None), (5, None, "en", "a", None), (None, None, None, None, None), (None, "The quick brown fox jumps over the lazy dog", None, None, None),
        (7, LONG, "xx", "a", len(LONG)), (8, LONG + " tail", "xx", "c", None), (9, "   \n\t ", "en", "c", 6), (10, "\u0000\u001c  é", "", "", 5),
    ]
