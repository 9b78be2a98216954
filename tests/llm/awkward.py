"""Small document tables with every awkward case."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, size int, ids string"
WORDS = "the of lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing"]) + str(rng.randrange(400)) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Ids and texts: nulls, empty, blank, one word, long, copies, near copies, shared passages."""
    base, passage = prose(1, 120), prose(2, 45)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, base),
        (1, base),
        (2, " ".join(near)),
        (3, base.upper()),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "word"),
        (8, "Word"),
        (9, f"{prose(3, 30)} {passage} {prose(4, 30)}"),
        (10, f"{prose(5, 50)}\n\n{passage}  {prose(6, 10)} "),
        (11, f"{passage} {passage}"),
        (12, prose(7, 20_000)),
        (12, prose(8, 25)),
        (13, prose(9, 25)),
        (13, prose(9, 25)),
        (None, base),
        (None, None),
        (14, "naïve ça 漢字 K elvin İ <|endoftext|>  two  spaces   x"),
        (15, "released under the MIT License, Apache License, Version 2.0; CC BY-NC and CC by nc"),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    """The awkward rows, with extra columns whose names operators might use themselves."""
    rows = [(i, t, "en", ["a", "b", None][k % 3], None, "r", 1, "x") for k, (i, t) in enumerate(awkward())]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
