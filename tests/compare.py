"""Compare a Spark query with its DuckDB oracle: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def spark_rows(df):
    order = sorted(df.columns)
    return order, Counter(tuple(_value(r[c]) for c in order) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, Counter(tuple(_value(r[i]) for i in at) for r in cur.fetchall())


def difference(spark_side, duck_side, show: int = 3) -> str:
    """Empty when both sides agree, else what differs."""
    (sc, s), (dc, d) = spark_side, duck_side
    if sc != dc:
        return f"columns differ: {sc} / {dc}"
    if s == d:
        return ""
    only_s, only_d = s - d, d - s
    lines = [f"rows {sum(s.values())} / {sum(d.values())}, only spark {sum(only_s.values())}, only oracle {sum(only_d.values())}"]
    a, b = sorted(only_s, key=repr)[:show], sorted(only_d, key=repr)[:show]
    for x, y in zip(a, b):
        lines.append("  " + "; ".join(f"{c}: {p!r} / {q!r}" for c, p, q in zip(sc, x, y) if p != q))
    for x in (a[len(b):] + b[len(a):])[:show]:
        lines.append(f"  {x!r}")
    return "\n".join(lines)
