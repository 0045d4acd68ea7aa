"""Compare registered queries with their SQL twins: python tests/check_catalog.py [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(plain(v)) for v in value) + "]"
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in sorted(value.items())})
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return f"{type(value).__name__}:{value}"


def compare(spark_df, con, sql: str) -> str | None:
    rows = spark_df.collect()
    names = sorted(spark_df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in rows), key=str)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns differ: spark {names} sql {sorted(cols)}"
    order = [cols.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=str)
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ; {names}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None if got else "no rows on either side"


def main(argv):
    import __spark_entry__ as entry
    from tests.session import make_session

    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = duck(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n == a or n.startswith(a) for a in argv)]
    failed = []
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                mid = time.time()
                problem = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                problem = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - start
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {took:.1f}s{'' if name in oracles else ' (rows only)'}", flush=True)
        if problem:
            failed.append(name)
            print("     " + problem, flush=True)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
