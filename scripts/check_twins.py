"""Run registered queries against their SQL twins: python scripts/check_twins.py [folder] [name...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from plantgauge.catalog import ORACLES, QUERIES
from plantgauge.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = local_session(int(os.environ.get("CPUS", "8")))
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    con.execute("SET TimeZone='UTC'")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            got = rows_of(df.columns, [tuple(x) for x in df.collect()])
        except Exception as e:
            print(f"{name:28s} SPARK ERROR {str(e)[:700]}")
            bad += 1
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"{name:28s} rows-only {len(got[1])} rows {took:.2f}s")
            continue
        try:
            start = time.time()
            cur = con.execute(ORACLES[name])
            want = rows_of([d[0] for d in cur.description], cur.fetchall())
            sql_took = time.time() - start
        except Exception as e:
            print(f"{name:28s} SQL ERROR {str(e)[:700]}")
            bad += 1
            continue
        kinds = {c: (a, str(d[1])) for (c, a), d in zip(sorted(df.dtypes), sorted(cur.description))}
        if got == want:
            flag = "" if got[1] else " (EMPTY)"
            print(f"{name:28s} ok {len(got[1])} rows {took:.2f}s sql {sql_took:.2f}s{flag}", flush=True)
        else:
            bad += 1
            print(f"{name:28s} DIFFERENT rows {len(got[1])} vs {len(want[1])} cols {got[0] == want[0]}")
            print("   types", kinds)
            if got[0] != want[0]:
                print("   ", got[0], "\n   ", want[0])
            shown = 0
            for a, b in zip(got[1], want[1]):
                if a != b and shown < 3:
                    print("    spark", a, "\n    sql  ", b)
                    shown += 1
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
