"""Every registered query against its SQL on the smallest tables."""

import datetime
import decimal

import pytest

from conftest import SMALL
from lodegraph.plans import ORACLE, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float | decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def same_rows(left_columns, left, right_columns, right):
    assert sorted(left_columns) == sorted(right_columns)

    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)

    assert rows(left_columns, left) == rows(right_columns, right)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE[name])
    same_rows(got.columns, [tuple(r) for r in got.collect()], [c[0] for c in want.description], want.fetchall())


def test_every_query_reads_the_tables():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_packets_hold_one_pattern(spark):
    """No step of s10 gathers all patterns of a brand into one row."""
    plan = QUERIES["s10_packet_loader"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" in plan
