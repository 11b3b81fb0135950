"""Groups of exact copies are dealt over many tasks."""

from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from settlespark.llm import jaccard


def test_copies_of_one_document_are_not_one_group(spark, monkeypatch):
    sizes, apply = [], GroupedData.applyInArrow

    def watched(self, *args):
        sizes.append(self._df.groupBy("family", "i", "j").count().agg(F.max("count")).first()[0])
        return apply(self, *args)

    monkeypatch.setattr(GroupedData, "applyInArrow", watched)
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text) for i in range(800)], "doc_id long, text string").repartition(2)
    assert {(r.component_id, r.n_shingles) for r in jaccard.join(docs).collect()} == {(0, 57)}
    assert sizes and max(sizes) < 400
