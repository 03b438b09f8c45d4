"""The driver contract: names, SQL and the flagship query."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_base_library_does_not_import_the_subpackage():
    import pathlib

    top = pathlib.Path(entry.__file__).parent / "spanforge"
    assert not [p for p in top.rglob("*.py") if "llm" not in p.parts and "spanforge.llm" in p.read_text()]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert [r.tau for r in rows] == [0.1, 0.3, 0.5, 0.7, 0.999] and all(0 <= r.reachable <= 1 for r in rows)
