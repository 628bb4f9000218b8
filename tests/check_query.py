"""Compare queries with their SQL checks: python tests/check_query.py [names..] (all by default)."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql):
    """(ok, message); rows as multisets, columns by name."""
    rel = con.sql(sql)
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    cols = sorted(df.columns)
    spark_types = dict(df.dtypes)
    got = sorted((tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=_key)
    quoted = ", ".join('"' + c + '"' for c in cols)
    want = sorted((tuple(_plain(x) for x in r) for r in con.sql(f"SELECT {quoted} FROM ({sql}) q").fetchall()), key=_key)
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}; got {got[:2]} want {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return False, f"{cols}\n   got  {a}\n   want {b}"
    return True, f"{len(got)} rows {spark_types}" if os.environ.get("TYPES") else f"{len(got)} rows"


def main():
    import __spark_entry__ as entry
    from turnlake.session import build_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[1:] or list(queries)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, sf)
            if name in oracle:
                ok, msg = compare(df, con, oracle[name])
            else:
                ok, msg = True, f"rows-only {len(df.collect())}"
        except Exception as e:  # report and go on
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time()-t0:.1f}s {msg}", flush=True)
    print(f"{bad} failed of {len(names)}")


if __name__ == "__main__":
    main()
