"""Order-insensitive comparison of two pandas frames by value."""

import datetime

import pandas as pd


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return ""
    if isinstance(v, datetime.date):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item") and getattr(v, "ndim", 1) == 0:
        v = v.item()
    if isinstance(v, float):
        return "" if v != v else str(int(v)) if v == int(v) and abs(v) < 2**53 else repr(v)
    return str(v.tolist() if hasattr(v, "tolist") else v)


def rows(frame, columns):
    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist())


def assert_same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert len(a) == len(b)
    assert rows(a, columns) == rows(b, columns)
