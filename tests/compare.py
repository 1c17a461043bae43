"""Order-insensitive comparison of a DataFrame with DuckDB's rows."""

from __future__ import annotations

import datetime
import math


def settled(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(settled, x))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def same_rows(df, relation) -> None:
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    ours = sorted(repr(tuple(settled(r[c]) for c in columns)) for r in df.collect())
    theirs = sorted(repr(tuple(settled(r[i]) for i in at)) for r in relation.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not wrong, wrong[:3]
