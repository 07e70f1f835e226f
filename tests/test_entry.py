import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parents[1]
SMOKE = "/root/testdata/sf0.001"


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "accuracy_grouping_sets" in e.queries()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9


def test_rest_imports_without_the_subpackage(tmp_path):
    for name in ("millrace", "__spark_entry__.py"):
        src = ROOT / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(any(n.startswith('op1') for n in e.queries()), len(e.queries()) > 100)"], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == ["False", "True"]


def test_import_errors_inside_the_subpackage_are_told(tmp_path):
    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True, check=False, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)})
    assert said.returncode and "no_such_module" in said.stderr


#: What queries without SQL must hold on the smallest tables.
HOLDS = {
    "hungarian_match": lambda r: len({(x["key"], x["i"]) for x in r}) == len({(x["key"], x["j"]) for x in r}) == len(r) > 0 and min(x["score"] for x in r) >= 0,
    "corpus_bleu": lambda r: len(r) == 1 and 0.9 < r[0]["bleu"] < 1,
    "norm_asr": lambda r: len(r) > 0 and all(v is None or v == v.strip() for x in r for v in x if isinstance(v, str)),
    "wer": lambda r: len(r) == 87 and all(0 < x["wer"] <= 1 for x in r),
}


@pytest.mark.parametrize("name", list(HOLDS))
def test_queries_without_sql(spark, name):
    from millrace.plans.catalog import ORACLE, QUERIES

    assert name not in ORACLE and HOLDS[name](QUERIES[name](spark, SMOKE).collect())


def test_every_query_of_the_library_has_sql_or_a_check():
    from millrace.plans.catalog import ORACLE, QUERIES

    assert set(QUERIES) - set(ORACLE) == set(HOLDS)
