import pytest

WORDS = "the of and stream table shuffle merge union bloom filter sketch window river stone".split()


def prose(n, seed=0):
    x, out = seed * 7919 + 13, []
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x >> 8 & 15 if x >> 8 & 15 < len(WORDS) else 3] + ("" if x % 3 else str(x % 97)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case: nulls in all columns, empty and blank texts, a very long one, repeats, shared ids,
    and columns that clash with names used inside the operators."""
    long = ". ".join(prose(9, k).capitalize() for k in range(4000))
    rows = [
        (1, prose(60, 1), "en", "a"),
        (2, prose(60, 1), "en", "b"),
        (2, prose(60, 1), "en", "b"),
        (3, None, None, None),
        (4, "", "en", "c"),
        (5, " \n\t ", "en", "c"),
        (6, long, "fr", "c"),
        (7, "ok", None, "c"),
        (8, "12345 !!", "fr", "c"),
        (9, "漢字テスト の 文。これは 長い 文 です", "ja", "c"),
        (None, prose(40, 5), "en", "d"),
        (None, None, None, None),
    ]
    cols = "doc_id long, text string, lang string, source string"
    clash = "id long, key string, row string, block int, rep int, n int, h string, spans string, text_ string, piece int, range int, guest boolean, path string"
    blank = (None,) * 13
    return spark.createDataFrame([r + blank for r in rows], f"{cols}, {clash}")
