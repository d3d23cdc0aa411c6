"""Every registered query of the core: the same rows as its SQL, or rows with its columns and defined values."""

import json

import pytest

from quillmark.plans import answering, ingest, loading, problems, retrieval

QUERIES = retrieval.QUERIES | ingest.QUERIES | answering.QUERIES | loading.QUERIES | problems.QUERIES
ORACLE = retrieval.ORACLE | ingest.ORACLE | answering.ORACLE | loading.ORACLE | problems.ORACLE


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE[name])


def repaired_records_hold(rows):
    """Every record that is there is an object; every other row stays, with null."""
    assert all(r.record is None or isinstance(json.loads(r.record), dict) for r in rows)
    assert sum(r.record is not None for r in rows) > len(rows) / 2


HOLDS = {"repaired_records": repaired_records_hold}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_holds(name, spark, data):
    df = QUERIES[name](spark, data)
    assert len(df.columns) == len(set(df.columns))
    rows = df.collect()
    assert rows
    HOLDS[name](rows)


def test_entry_point(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(QUERIES) <= set(names)
    assert set(entry.oracle_sql()) <= set(names)
