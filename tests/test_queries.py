"""Every registered query of the engine against its SQL, at the smallest scale."""

import datetime
import decimal

import pytest

from sparkloom import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{v:.6g}" if abs(v) < 10**6 else str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_queries_without_sql(spark):
    rest = set(catalog.queries()) - set(catalog.oracle_sql())
    assert rest == {"bootstrap_interval"}
    for r in catalog.queries()["bootstrap_interval"](spark, SF).collect():
        assert r["low"] <= r["mean_difference"] <= r["high"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
