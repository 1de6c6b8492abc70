"""Every query of the library returns what its SQL returns."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quillstream import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    same_rows(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLES[name]).df())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_points_without_the_optional_folders(tmp_path):
    """In a copy without the llm folders the queries of the library are all there, with corpus_pipeline.py in place or not."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quillstream", tmp_path / "quillstream", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    script = "import __spark_entry__ as e; assert sorted(e.queries()) == sorted(e.catalog.QUERIES) and set(e.oracle_sql()) <= set(e.queries())"
    for name in (None, "corpus_pipeline.py"):
        if name and (root / name).exists():
            shutil.copy(root / name, tmp_path)
        subprocess.run([sys.executable, "-c", script], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p) != root)})
