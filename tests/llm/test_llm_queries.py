import pytest

from veriloom.llm.oracles import ORACLE_SQL
from veriloom.llm.queries import QUERIES


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert rows(got.columns, map(tuple, got.collect())) == rows(names, cur.fetchall())


COLUMNS = {
    "p1_found": {"document": "string", "ord": "bigint"}, "p2_found": {"id": "string", "name_rec": "bigint", "mentions_rec": "bigint"},
    "p3_found": {"id_a": "string", "id_b": "string"}, "p4_found": {"id": "string", "group_id": "string"},
    "p5_found": {"seg_id": "bigint", "start_char": "int", "end_char": "int"}, "p6_found": {"seg_id": "bigint", "line_no": "int", "kind": "string"},
    "p7_found": {"id_a": "string", "id_b": "string"}, "p10_found": {"doc_a": "bigint", "doc_b": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(name, spark, sf):
    df = QUERIES[name](spark, sf)
    assert dict(df.dtypes) == COLUMNS[name]
    n = df.count()
    assert n == df.distinct().count() and n > 0
