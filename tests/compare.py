"""Runs registered queries against their SQL and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, datetime.datetime) and v.tzinfo is not None:
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is not None, str(type(v).__name__) if not isinstance(v, (int, float)) else "n", v if not isinstance(v, bool) else int(v))
                 for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=_key)


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, value for value; otherwise what differs first."""
    names, got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"columns {names} / {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)} rows"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {names}: {bad[0][0]} / {bad[0][1]}"
    types = {n: t for n, t in spark_df.dtypes}
    return None if types else "no columns"
