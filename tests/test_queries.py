import pytest

from quire import queries

SF = "/root/testdata/sf0.001"
ALL, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(name, same):
    same(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(name, spark):
    assert ALL[name](spark, SF).count() > 0


def test_properties_of_rewritten_pages(spark):
    rows = ALL["normalize_pages"](spark, SF).collect()
    assert all(r.text_kept and r.settled for r in rows)
    assert all(r.same for r in ALL["archive_round_trip"](spark, SF).collect())


def test_books_are_normalized_the_same_each_time(spark):
    from quire.plans import normalize

    first, again = ({r.book_id: (bytes(r.output), r.error) for r in normalize.normalize(queries.books(spark, SF)).collect()} for _ in range(2))
    assert first == again and all(e is None for _, e in first.values())
