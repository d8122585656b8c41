"""Rows of both engines in one comparable form."""

import datetime
import decimal


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(df, relation):
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall())
