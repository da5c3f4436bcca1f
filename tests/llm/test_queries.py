import __spark_entry__
from planloom.llm import queries


def test_registered():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "pipeline" in names and set(queries.QUERIES) < set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(sql) <= set(names)
