"""Rules the source text itself must keep."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "settlespark"
SOURCES = {p: p.read_text() for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts}


def test_no_floating_point_money():
    for path, text in SOURCES.items():
        assert not re.search(r"""\bas (double|float)\b|["'](double|float)["']|DoubleType|FloatType""", text), path


def test_no_python_udf_rdd_or_local_checkpoint():
    for path, text in SOURCES.items():
        assert not re.search(r"\b(udf|pandas_udf|mapPartitions|localCheckpoint|toPandas|crossJoin|\.rdd)\b", text), path


def test_collect_reaches_the_driver_only_for_the_cash_rounds():
    using = {p.name for p, text in SOURCES.items() if ".collect()" in text}
    assert using == {"payouts.py"}
