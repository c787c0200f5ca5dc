from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = COLUMNS + ", score double, row int, mix string, key string, answer int, cell long, place int, s string, u int, run int"


def prose(rng: random.Random, words: int, syllables: str = "an er on th ing ti be of re at") -> str:
    parts = syllables.split()
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(words)]
    return " ".join(w + ("." if i % 9 == 8 else "") for i, w in enumerate(out))


def documents() -> list[tuple]:
    rng = random.Random(5)
    other = "ß ch ung keit ü der ein sch"
    rows = [(i, prose(rng, rng.randint(12, 120)), "en", f"src{i % 3}", 1) for i in range(60)]
    rows += [(i, prose(rng, rng.randint(12, 120), other), "de", "src0", 1) for i in range(60, 90)]
    rows += [
        (100, None, None, None, None), (101, "", "en", "src1", 0), (102, " \n\t ", "en", "src1", 4), (103, "a", "en", None, 1),
        (104, prose(rng, 30_000), "en", "src2", 1), (105, "!!! ### $$$ " * 40, "en", "src0", 1), (106, rows[3][1], "en", "src0", 1), (106, rows[3][1], "en", "src0", 1),
        (107, "Released under the MIT License. cc by\nNC cc-by-nc", "en", "src0", 1), (108, "naïve 漢字 ▁ 😀  two  spaces\n\n end ", "en", "src9", 1), (None, "no id here at all", "en", "src1", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd_rows():
    return documents()


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Documents with nulls, empty and long texts, repeats and extra columns whose names clash."""
    return spark.createDataFrame([(*r, 0.5, 1, "m", "k", 2, 3, 4, "s", 5, 6) for r in odd_rows], CLASHING).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
