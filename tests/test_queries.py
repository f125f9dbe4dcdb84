import pytest

from molframe import queries
from molframe.functions.mixing import MIN, signed, splitmix64_int
from tests.conftest import DATA
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, DATA, queries.QUERIES[name], queries.SQL[name])


def test_tie_hash_equals_python(spark):
    for r in queries.tie_hash(spark, DATA).where("o_orderkey < 200").collect():
        assert r.mixed == signed(splitmix64_int(r.o_orderkey))
        assert r.rank_key == r.mixed ^ MIN


def test_greedy_selection_equals_a_plain_loop(spark):
    got = {}
    for r in queries.greedy_spaced_selection(spark, DATA).orderBy("label", "turn").collect():
        got.setdefault(r.label, []).append(r.id)
    points = {}
    for r in queries._points(spark, DATA).collect():
        points.setdefault(r.label, []).append((r.id, (r.x, r.y, r.z), r.q, splitmix64_int(r.id)))
    for label, rows in points.items():
        chosen = []
        for rising in [True, False, True, False][: len(rows)]:
            free = [r for r in rows if r[0] not in [c[0] for c in chosen]]
            free.sort(key=lambda r: (r[2] if rising else -r[2], r[3]))
            far = [r for r in free if all(sum((a - b) ** 2 for a, b in zip(r[1], c[1])) >= 0.09 for c in chosen)]
            chosen.append((far or free)[0])
        assert got[label] == [c[0] for c in chosen]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
