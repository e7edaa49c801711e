"""Run a registered query and its SQL twin on the same tables and compare them."""

from __future__ import annotations

import glob
import os

import duckdb

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr), [names[i] for i in order]


def differences(df, con, sql: str) -> list[str]:
    """Empty if names, types and all rows agree."""
    out = []
    got, got_names = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    types = {c[0]: str(c[1]) for c in cur.description}
    want, want_names = _rows([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind) != types[name]:
            out.append(f"type of {name}: {kind} != {types[name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {str(wrong[0][0])[:600]} != {str(wrong[0][1])[:600]}")
    return out
