"""Compare a registered query with its SQL on one folder of tables."""

import glob
import sys
from pathlib import Path

import duckdb

import __spark_entry__ as entry


def differs(spark, name, d):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, d)
    cols = sorted(df.columns)
    norm = lambda x: round(x, 5) + 0.0 if isinstance(x, float) else x
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = con.execute(entry.oracle_sql()[name])
    at = [[x[0] for x in res.description].index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in res.fetchall()), key=repr)
    return [] if got == want else [(len(got), len(want)), *sorted(set(got) - set(want), key=repr)[:4], "<>", *sorted(set(want) - set(got), key=repr)[:4]]


if __name__ == "__main__":
    import time

    from quillspark.session import get_session

    s = get_session("local[8]", "oracle", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    for n in sys.argv[2:]:
        t = time.time()
        print(n, differs(s, n, sys.argv[1]) or "equal", round(time.time() - t, 1), flush=True)
