"""Run registered queries next to their SQL on the same parquet files and compare the rows.

``python tests/oracle.py [--sf DIR] [--sql] [name ...]`` prints one line per query; ``--sql`` leaves out those without SQL.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.01"


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canonical(v)) for k, v in value.items())
    if type(value).__name__ == "Decimal":
        return float(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, f"{len(got)} rows, columns {got_cols}"
    rel = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} vs {want_cols}"
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return False, f"{len(got)} vs {len(want)} rows; first differences {diff}"
    return True, f"{len(got)} rows"


def main(argv):
    sf_dir = SF
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    only_sql = "--sql" in argv
    argv = [a for a in argv if a != "--sql"]
    import __spark_entry__ as entry
    from siftworks.session import local_session

    spark = local_session("oracle")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if argv and not any(name.startswith(a) for a in argv) or only_sql and name not in oracles:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += ok is False
        mark = {True: "ok  ", False: "BAD ", None: "rows"}[ok]
        print(f"{mark} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
