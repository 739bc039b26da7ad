"""Run a registered query and its SQL check side by side.

``python -m tests.harness [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata/sf{}"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA.format(sf)}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def table_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=_key)


def spark_table(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def oracle_table(con, sql):
    rel = con.execute(sql)
    return table_of([c[0] for c in rel.description], rel.fetchall())


def compare(df, con, sql):
    """None when equal, else a short text on the difference."""
    sc, sr = spark_table(df)
    oc, orows = oracle_table(con, sql)
    if sc != oc:
        return f"columns {sc} / {oc}"
    if len(sr) != len(orows):
        return f"rows {len(sr)} / {len(orows)}"
    bad = [(a, b) for a, b in zip(sr, orows) if a != b]
    return f"{len(bad)} of {len(sr)} rows differ, first {sc}: {bad[0]}" if bad else None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--no-oracle", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from foldwise.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    con = connect(args.sf)
    failed = 0
    for name in args.names or queries:
        t = time.time()
        try:
            df = queries[name](spark, DATA.format(args.sf))
            if name in sqls and not args.no_oracle:
                diff = compare(df, con, sqls[name])
                state = "ok" if diff is None else "DIFF " + diff
            else:
                rows = df.collect()
                state = f"rows {len(rows)} {rows[:2]}"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            state = "ERROR " + str(e)[:1500]
        failed += state.startswith(("DIFF", "ERROR"))
        print(f"{name:32s} {time.time() - t:6.1f}s {state}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
