import os
import random
import sys

import pytest

from settlespark.llm.common import ship

sys.path.insert(0, os.path.dirname(__file__))

from llm_cases import sentence  # noqa: E402

@pytest.fixture(scope="session", autouse=True)
def code_on_workers(spark):
    ship(spark)


@pytest.fixture(scope="session")
def cases():
    """(doc_id, text): nulls, empty and very long texts, ties, exact and near copies, repeated lines, odd characters."""
    rnd = random.Random(11)
    texts = {0: None, 1: "", 2: " \t\n\x0b ", 3: "one", 4: "two words", 5: "ß€😀  x y", 6: "x" * 9000, 7: " " * 3000 + "y", 8: "a b c d " * 40}
    for i in range(10, 60):
        texts[i] = "\n".join(sentence(rnd, rnd.randint(8, 30)) for _ in range(rnd.randint(1, 8)))
    texts[60] = "\n".join(sentence(rnd, 40) for _ in range(400))  # very long
    for i in range(61, 75):
        texts[i] = texts[10 + i % 3]
    for i in range(75, 90):
        words = texts[20 + i % 2].split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    return texts


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept string, n_lines string, start string, v int"


@pytest.fixture(scope="session")
def docs(spark, cases):
    """The cases as a table with extra columns whose names clash with those of results."""
    rows = [(i, t, None if i % 7 == 0 else "en", f"s{i % 3}", len(t or ""), "c", "k", "n", "s", 1) for i, t in cases.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
