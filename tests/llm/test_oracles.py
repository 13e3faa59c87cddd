import pytest

from quire.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, same):
    same(queries.queries()[name], SQL[name])


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
