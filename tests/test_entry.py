import subprocess
import sys
from pathlib import Path

import duckdb
import pandas
import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or v is pandas.NA or v != v:
        return "~"
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) else v


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(_value, r))) for r in frame.itertuples(index=False))


def _names():
    sys.path.insert(0, str(ROOT))
    from geolith.plans import registry

    return sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_sql(spark, name):
    from geolith.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


def test_sql_names_are_queries():
    from geolith.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    assert {"vec_id", "points", "quantity"} == set(__spark_entry__.entry(spark).columns)


def test_rest_imports_without_the_optional_part(tmp_path):
    """The entry module works where the llm folder and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "geolith", tmp_path / "geolith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'pip_join' in e.queries() and 'pipeline' not in e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
