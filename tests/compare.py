"""Rows of a DataFrame and of SQL in a common form."""

import math
from decimal import Decimal


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, Decimal):
        return float(v)
    return int(v) if isinstance(v, bool) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)


def same(a, b, tolerance=1e-5):
    return len(a) == len(b) and all(
        len(x) == len(y) and all(u == v or isinstance(u, int | float) and isinstance(v, int | float) and abs(u - v) <= tolerance * max(1, abs(u)) for u, v in zip(x, y, strict=True)) for x, y in zip(a, b, strict=True)
    )
