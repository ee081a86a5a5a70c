from __future__ import annotations

import random

import pytest

from corpusmill.llm.common import ship_package

WORDS = "the of and storm river glass copper lantern meadow signal winter harbor engine marble".split()
#: Columns whose names the operators use inside, null ids and texts, empty texts, repeated rows.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, before long, score double"


@pytest.fixture(autouse=True)
def _shipped(spark):
    ship_package(spark)


def sentence(draw: random.Random, n: int) -> str:
    return " ".join(draw.choice(WORDS) + str(draw.randrange(30)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    draw = random.Random(3)
    passage = sentence(draw, 70)
    out = [
        (None, "text without an id " * 12, "en", "a", None, 1, 2, 3, 0.5),
        (1, None, None, None, None, None, None, None, None),
        (2, "", "en", "a", 0, 0, 0, 0, 0.0),
        (3, " \n\t ", "en", None, 4, 0, 0, 0, 0.0),
        (4, "one two", "en", "b", 7, 0, 0, 0, 0.0),
        (5, sentence(draw, 9000), "en", "a", 0, 0, 0, 0, 0.0),
        (6, "é" * 300 + "\nŸ ŸŸ\n", "fr", "é", 0, 0, 0, 0, 0.0),
    ]
    for i in range(7, 60):
        body = sentence(draw, draw.randrange(30, 120))
        if i % 3 == 0:
            body = passage + " " + body
        if i % 5 == 0:
            body = out[-1][1]
        out.append((i, body, "en", "hot" if i % 2 else f"s{i % 4}", len(body), 9, 9, 9, 9.0))
    out += [out[20], out[20], (21, "another text under a used id " + passage, "en", "b", 1, 1, 1, 1, 1.0)]
    return out


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(i, int(i % 3 > 0), 0) for i in range(2, 60)] + [(7, None, 0), (None, 1, 0), (8, 1, 0)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture
def benchmark(spark, rows):
    text = rows[9][1].upper()
    return spark.createDataFrame(
        [(1, " ".join(text.split()[3:30])), (2, "One, TWO!"), (3, None), (None, "x"), (10, "!!"), (2, "One, TWO!")],
        "item_id long, text string",
    )
