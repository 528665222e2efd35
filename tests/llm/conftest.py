from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, extra columns whose names clash with internal ones."""
    long = " ".join(f"word{i * 7919 % 4001}" for i in range(30_000))
    prose = [" ".join(f"w{(i * 37 + k * k) % 1009}" for k in range(80)) for i in range(12)]
    rows = [(1, "", "en", "s1", 0, "a", 1), (2, None, None, None, None, None, None), (None, None, None, None, None, None, None),
            (None, prose[0], "en", None, 9, "b", 2), (3, long, "en", "s0", 1, "c", 3), (3, long, "en", "s0", 1, "c", 3), (4, " \n\t ", "en", "s1", 4, "d", 4),
            (-5, "x", "en", "s2", 1, "e", 5), (6, prose[1], "de", "s0", 2, "f", 6), (7, prose[1], "de", "s2", 2, "g", 7), (7, prose[1], "de", "s2", 2, "g", 7),
            (10, prose[4] + " " + prose[4], "de", "s2", 2, "h", 7)]
    rows += [(20 + i, p, "fr", f"s{i % 4}", i, "z", i) for i, p in enumerate(prose)]
    rows += [(40, prose[5] + ' token = "9b74c9897bac770ffc029102a200c5de" call 555-0199-22', "en", "s1", 1, "i", 1), (41, "é ñ ß 日本 \x1c\x85 😀", "ja", "s1", 1, "j", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows
