"""Stages on tables whose extra columns have the names that the operators use themselves."""

import pytest

from llm_cases import sentence
from settlespark.llm import common, jaccard, line_dedup, packing, quality
from pyspark.sql import functions as F

NAMES = ["_gone", "_slot", "_word", "_bits", "_maybe", "_lines", "_gone_id", "_fact_key", "found", "Found_", "lines", "maybe", "slot", "word", "held", "fact_doc_id", "gone_key"]


@pytest.fixture(scope="module")
def rows():
    import random

    rnd = random.Random(21)
    texts = [sentence(rnd, 70) for _ in range(30)]
    return [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts[:10])] + [(200, "too short"), (201, None), (None, texts[0])]


def _table(spark, rows, more):
    made = spark.createDataFrame([(*r, "en", "web") for r in rows], "doc_id long, text string, lang string, source string")
    return made.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in more]).repartition(3)


@pytest.mark.parametrize("more", [NAMES, ["n_lines", "_n_removed"], ["N_LINES", "N_Removed"]])
@pytest.mark.parametrize("stage", [quality.keep_good, line_dedup.dedup_lines, jaccard.keep_one])
def test_other_columns_stay_as_they_are(spark, rows, stage, more):
    found = stage(_table(spark, rows, more))
    kept = [n for n in more if stage is not line_dedup.dedup_lines or n.lower() not in ("n_lines", "n_removed")]
    assert [c for c in found.columns if c in ("doc_id", "text", *kept)] == ["doc_id", "text", *kept]
    out = found.select("doc_id", *kept).collect()
    ids = sorted(str(r.doc_id) for r in out)
    assert all(r[n] == f"{n} of {'-' if r.doc_id is None else r.doc_id}" for r in out for n in kept)
    plain = stage(_table(spark, rows, [])).select("doc_id").collect()
    assert ids == sorted(str(r.doc_id) for r in plain) and "None" in ids


def test_fresh_names_differ_whatever_the_case(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "id int, Slot int, slot_ int")
    assert common.fresh(rows, "slot", "slot", "ID") == ["slot__", "slot___", "ID_"]


def test_tokenizer_forgets_between_texts_only(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "REMEMBERED", 10)
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.WordTokenizer(path)
    texts = [["one two three four five six seven eight nine"], ["one two ten eleven twelve thirteen fourteen fifteen sixteen nine"], ["a b c d e f g h i j k l m one", "one sixteen z"]]
    for chunk in texts:
        assert own.ids(chunk) == packing.WordTokenizer(path).ids(chunk)
        for text, raw in zip(chunk, own.ids(chunk)):
            import numpy as np

            assert np.frombuffer(raw, "<u4").tolist() == own.own.encode(text, add_special_tokens=False).ids
