"""Run a registered query and its SQL over the same tables and compare the results."""

from __future__ import annotations

import datetime
import glob
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, datetime.datetime | datetime.date):
        return str(value)
    if isinstance(value, float):
        return float(repr(round(value, 9)))
    return value


def _table(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def differences(spark_df, con, sql: str, limit: int = 3) -> list[str]:
    got = _table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = _table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return [f"columns {got[0]} against {want[0]}"]
    if len(got[1]) != len(want[1]):
        return [f"{len(got[1])} rows against {len(want[1])}"] + [
            f"{g}" for g in got[1][:limit]] + [f"{w}" for w in want[1][:limit]]
    if not got[1]:
        return ["no rows"]
    types = [
        f"types {g} against {w}" for g, w in zip(got[1], want[1])
        if [type(x) for x in g] != [type(x) for x in w]
    ]
    return [f"{g} against {w}" for g, w in zip(got[1], want[1]) if g != w][:limit] + types[:1]
