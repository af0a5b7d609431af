"""Every core query equals its SQL statement on the smallest data."""

import pytest

from veriloom.plans import catalog

catalog.load()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(name, spark, sf, duck):
    got = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, cur.fetchall())
