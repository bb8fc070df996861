"""Every catalog query against its SQL."""

from __future__ import annotations

import pytest
from compare import DATA, assert_same

from loomquant import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck):
    assert_same(QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_do_not_follow_partitions(name, spark):
    """Queries without SQL have rows, without NaN, and the same ones however the table is dealt out."""
    got = []
    for n in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(QUERIES[name](spark, DATA).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got[0]) and not any(v != v for c in got[0].select_dtypes("float") for v in got[0][c].dropna())
    for frame in got:
        for c in frame.select_dtypes("float"):
            frame[c] = frame[c].round(7)
    assert_same(*got)


def test_entry_imports_without_training_data_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for part in ("loomquant", "__spark_entry__.py"):
        source = os.path.join(root, part)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / part)
    shutil.rmtree(tmp_path / "loomquant" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 100 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
