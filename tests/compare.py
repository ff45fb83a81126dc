"""Run queries next to their oracles: ``python tests/compare.py [sf] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

from slickwatch.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from slickwatch.plans.views import TABLES  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _norm(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if hasattr(value, "item"):
        return _norm(value.item())
    return value


def normal_rows(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_norm(row[i]) for i in order) for row in frame_rows), key=lambda r: tuple(map(repr, r))
    )


def compare(spark, con, key, folder):
    """Empty text when the query equals its oracle, else what differs."""
    df = QUERIES[key](spark, folder)
    rel = con.execute(ORACLES[key])
    duck_cols = [c[0] for c in rel.description]
    duck_types = [str(c[1]) for c in rel.description]
    duck = rel.fetchall()
    rows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(duck_cols):
        return f"columns {sorted(df.columns)} vs {sorted(duck_cols)}"
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    mine = dict(df.dtypes)
    bad = [(c, mine[c], t) for c, t in zip(duck_cols, duck_types) if names.get(t, t) != mine[c]]
    if bad:
        return f"types {bad}"
    a, b = normal_rows(rows, df.columns), normal_rows(duck, duck_cols)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, cols {sorted(df.columns)}: {diff[0][0]} vs {diff[0][1]}"
    return "" if a else "EMPTY"


if __name__ == "__main__":
    from slickwatch.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("compare"), connect(folder)
    keys = sys.argv[2:] or list(QUERIES)
    failed = 0
    for key in keys:
        start = time.time()
        try:
            if key in ORACLES:
                text = compare(spark, con, key, folder)
            else:
                n = QUERIES[key](spark, folder).count()
                text = "" if n else "EMPTY"
                key += " (rows only)"
        except Exception as err:  # noqa: BLE001
            text = f"{type(err).__name__}: {str(err)[:600]}"
        failed += bool(text)
        print(f"{'ok  ' if not text else 'FAIL'} {key} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} ok")
