"""Comparison of a Spark result with DuckDB's, order aside."""

import math


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if not math.isinf(v) and v == int(v) and abs(v) < 1e15 else round(v, 9))
    return str(v) if hasattr(v, "isoformat") else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=str)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    own = [d[0] for d in found.description]
    names = sorted(own)
    at = [own.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
