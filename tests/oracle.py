"""Run a query and its SQL counterpart on the same tables and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty if columns, row count and all values agree exactly."""
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"] + [str(x) for x in list(set(got) ^ set(want))[:4]]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        cols = [(n, a, b) for n, a, b in zip(got_names, g, w) if a != b]
        return [f"{len(bad)} of {len(got)} rows differ, first: {cols} in {g}"]
    types = {type(v) for r in got[:50] for v in r} ^ {type(v) for r in want[:50] for v in r}
    return [f"types {types}"] if types - {type(None)} else []
