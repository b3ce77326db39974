"""Compare registered queries with their SQL: python tests/check_oracle.py [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def canon(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(canon(x) for x in v))
    return ("s", str(v))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(df, con, sql):
    got_cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in got_cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != got_cols:
        return f"columns {got_cols} vs {sorted(names)}"
    at = [names.index(c) for c in got_cols]
    want = sorted(tuple(canon(r[i]) for i in at) for r in res.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, a, b) for c, a, b in zip(got_cols, bad[0][0], bad[0][1]) if a != b]
        return f"{len(bad)}/{len(got)} rows differ, first {diff} in {bad[0][0]}"
    return None if got else "EMPTY"


def main(names, sf_dir="/root/testdata/sf0.01"):
    import __spark_entry__ as e
    from spikeloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    q, o = e.queries(), e.oracle_sql()
    picked = [n for n in q if not names or any(n == m or (m.endswith("*") and n.startswith(m[:-1])) for m in names)]
    failed = []
    for n in picked:
        t0 = time.time()
        try:
            df = q[n](spark, sf_dir)
            if n in o:
                err = compare(df, con, o[n])
            else:
                err = None if df.collect() else "EMPTY"
        except Exception as ex:  # noqa: BLE001
            err = "".join(traceback.format_exception_only(ex))[:1500]
        print(f"{'ok  ' if err is None else 'FAIL'} {n:34s} {time.time() - t0:6.1f}s {'' if n in o else '(rows only) '}{err or ''}", flush=True)
        if err:
            failed.append(n)
    print(f"{len(picked) - len(failed)}/{len(picked)} ok; failed: {failed}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))
