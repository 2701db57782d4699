"""Compares queries with their SQL on DuckDB: python tests/oracle.py [sf_dir] [name ...]"""

import glob
import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if v is not None and not isinstance(v, (int, str, bool)) else v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


def difference(frame, con, sql):
    """None if frame and SQL give the same columns and rows, else what differs."""
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in rel.description}
    want, got = rows_of(names, rel.fetchall()), rows_of(frame.columns, frame.collect())
    if "HUGEINT" in kinds.values():
        return f"SQL types {kinds}"
    if want == got:
        return None
    a, b = [x for x in got if x not in set(want)][:3], [x for x in want if x not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only Spark {a}; only SQL {b}"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import session

    import __spark_entry__ as entry
    from confab.plans.catalogue import QUERIES

    args = sys.argv[1:]
    sf = args.pop(0) if args and glob.glob(args[0] + "/*.parquet") else "/root/testdata/sf0.001"
    queries, oracles, spark, con = entry.queries(), entry.oracle_sql(), session(), connect(sf)
    bad = 0
    for name in args or [n for n in queries if n in QUERIES]:
        began = time.time()
        try:
            frame = queries[name](spark, sf)
            said = difference(frame, con, oracles[name]) if name in oracles else None if frame.count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            said = "error " + str(e)[:600]
        bad += said is not None
        print(f"{'ok  ' if said is None else 'DIFF'} {name} {time.time() - began:.1f}s {'' if name in oracles else '(no SQL)'} {said or ''}", flush=True)
    print(bad, "differ")
