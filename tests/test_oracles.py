"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math

import pytest

from leafworks.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in registry.ORACLES:
        assert rows
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    names = sorted(df.columns)
    places = [want.columns.index(n) for n in names]
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=repr)
