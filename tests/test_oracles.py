"""Every registered query of the main library beside its oracle, over the smallest tables."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from gleaner import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    assert compare(spark, SF, registry.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry_points_work_without_llm(tmp_path):
    """On a copy without the subpackage, its tests and the pipeline, the other queries are all there."""
    root = Path(__file__).resolve().parents[1]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache")])
    told = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any('llm' in m for m in __import__('sys').modules if m.startswith('gleaner')))"], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert told.stdout.split() == [str(len(registry.queries())), str(len(ORACLES)), "False"], told.stderr[-500:]
    used = [p for p in copy.rglob("*.py") if re.search(r"(from|import)\s+(gleaner)?[.\w]*\bllm\b|corpus_pipeline", p.read_text()) and p.name != "__spark_entry__.py" and p.name != "test_oracles.py"]
    assert used == []


def test_illegible_whole_sees_the_end_of_long_texts(spark, tmp_path):
    plain = "palabra " * 200
    texts = [(2, plain + "fin"), (2, plain + "f¡in"), (2, plain + "12345 " * 200), (3, None), (3, "á" * 11)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.roto for r in registry.queries()["illegible_whole"](spark, str(tmp_path)).collect()]
    assert got == [False, True, True, True, True]
