import pytest

from lattica.operators import ordered
from lattica.plans.registry import ORACLE_SQL, QUERIES, flagship
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    compare(spark, sf, QUERIES[name], ORACLE_SQL[name])


def test_flagship(spark, sf):
    assert flagship(spark, sf).count() > 0


def test_collapse_depends_on_the_last_kept(spark, sf):
    for row in QUERIES["WIN10_collapse_close"](spark, sf).collect():
        assert all(b - a > 150 for a, b in zip(row.kept, row.kept[1:]))


@pytest.mark.parametrize(("left", "right", "total"), [("abc", "abc", 0), ("abcd", "abd", 1), ("", "ab", 2), ("ab", "ba", 2)])
def test_align(left, right, total):
    pairs, cost = ordered.align(list(left), list(right), lambda x, y: float(x != y), 1.0)
    assert cost == total
    assert [i for i, _ in pairs if i is not None] == list(range(len(left)))
    assert [j for _, j in pairs if j is not None] == list(range(len(right)))


def test_alignment_covers_both_sides(spark, sf):
    got = QUERIES["JON2_alignment"](spark, sf).toPandas()
    events = spark.read.parquet(f"{sf}/events.parquet").count()
    assert got.left_order.notna().sum() + got.right_order.notna().sum() == events
