"""Compare a query with its SQL twin, row for row."""

import datetime as dt
import glob
import math

import duckdb


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, dt.datetime):
        return x.isoformat()
    if isinstance(x, dt.date):
        return x.isoformat()
    return float(x)


def _close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def twin(sql: str, folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = path.rsplit("/", 1)[1].removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    got = con.execute(sql)
    return [c[0] for c in got.description], [str(c[1]) for c in got.description], got.fetchall()


def difference(df, sql: str, folder: str) -> str:
    """Empty if equal."""
    names, kinds, rows = twin(sql, folder)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    mine, theirs = _rows(df.columns, df.collect()), _rows(names, rows)
    if len(mine) != len(theirs):
        return f"rows {len(mine)} and {len(theirs)}; {[x for x in mine if x not in theirs][:3]} {[x for x in theirs if x not in mine][:3]}"
    for a, b in zip(mine, theirs):
        if not all(map(_close, a, b)):
            return f"{a} and {b}"
    text = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}
    odd = {n: (k, dict(zip(names, kinds))[n]) for n, k in df.dtypes if text.get(k, k) != dict(zip(names, kinds))[n]}
    return f"types {odd}" if odd else ""
