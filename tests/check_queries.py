"""Compare registered queries with their SQL in DuckDB: ``python tests/check_queries.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple("∅" if pd.isna(v) else (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
    return sorted(out)


def compare(spark, con, fn, sql, sf_dir):
    """None when equal, else a text that says what differs; also the row count."""
    found = fn(spark, sf_dir).toPandas()
    if sql is None:
        return None, len(found)
    wanted = con.sql(sql).df()
    if sorted(found.columns) != sorted(wanted.columns):
        return f"columns {sorted(found.columns)} vs {sorted(wanted.columns)}", len(found)
    kinds = [
        f"{c}: {found[c].dtype} vs {wanted[c].dtype}" for c in sorted(found.columns)
        if len(found) and str(found[c].dtype) != str(wanted[c].dtype) and {found[c].dtype.kind, wanted[c].dtype.kind} - {"O"}
    ]
    a, b = rows_of(found), rows_of(wanted)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"rows {len(a)} vs {len(b)}; only spark {only_a}; only sql {only_b}; kinds {kinds}", len(a)
    if kinds:
        return f"types differ: {kinds}", len(a)
    return None, len(a)


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from probeline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    if os.environ.get("PLAIN_SESSION"):  # no settings at all, as a foreign driver might have it
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    qs, sqls = queries(), oracle_sql()
    names = sys.argv[2:] or sorted(qs)
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem, count = compare(spark, con, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # report and go on
            problem, count = f"{type(e).__name__}: {str(e)[:int(os.environ.get("SHOWN", "1500"))]}", 0
        state = "FAIL" if problem else ("rows" if n not in sqls else "ok")
        bad += bool(problem)
        print(f"{state:5}{n:28}{count:8}{time.time() - t:7.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    sys.exit(bool(bad))
