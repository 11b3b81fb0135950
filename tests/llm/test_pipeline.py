"""The pipeline's stages, one after the other, and the guard that lets the rest work without this subpackage."""

import os
import subprocess
import sys

import corpus_pipeline
import __spark_entry__
from settlespark.llm.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_eleven_queries_are_registered():
    names = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(QUERIES) < set(names)


def test_stages_return_the_columns_of_documents_and_keep_their_contracts(spark, docs):
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    before = {r.doc_id for r in now.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, now, "")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == now.columns and found.dtypes == now.dtypes
        now = spark.createDataFrame(found.collect(), found.schema)
        ids = {r.doc_id for r in now.collect()}
        assert ids <= before
        if name in ("line dedup", "secret scans", "packing"):
            assert ids == before
        before = ids
    assert before


def test_an_empty_table_runs_through(spark, no_docs):
    now = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, now, "")
        assert found.count() == 0
        now = now if "sequence_id" in found.columns else found


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "settlespark"):
        os.symlink(os.path.join(ROOT, name), tmp_path / name) if name.endswith(".py") else None
    (tmp_path / "settlespark").mkdir()
    for name in os.listdir(os.path.join(ROOT, "settlespark")):
        if name != "llm":
            os.symlink(os.path.join(ROOT, "settlespark", name), tmp_path / "settlespark" / name)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 100; print(len(e.oracle_sql()))"
    os.unlink(tmp_path / "__spark_entry__.py")
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
