"""Every registered query against its SQL twin."""

import os
import shutil
import subprocess
import sys

import pytest

from chunkloom.plans.oracle import ORACLE
from chunkloom.plans.queries import REGISTRY
from __spark_entry__ import entry, oracle_sql, queries

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(name, spark, duck, sf_dir):
    df = queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.execute(oracle_sql()[name])
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    theirs = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(names) == columns
    assert {c: TYPES[df.schema[c].dataType.simpleString()] for c in columns} == types
    assert _sorted(ours) == _sorted(theirs)


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    """A copy without them imports and registers the library's own queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/chunkloom", tmp_path / "chunkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = "import __spark_entry__ as e; print(*sorted(e.queries()))"
    names = subprocess.run([sys.executable, "-c", said], cwd=tmp_path, capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert names.stdout.split() == sorted(REGISTRY)


def test_every_query_but_the_approximate_one_has_a_twin():
    assert set(REGISTRY) - set(ORACLE) == {"knn_ivf"}
    assert set(ORACLE) <= set(REGISTRY) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    df = entry(spark)
    assert df.columns[:3] == ["query_id", "rank", "id"]
    assert df.count() == 200
