"""Run catalog queries on Spark and their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cpus="8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if isinstance(v, float):
        return repr(v + 0.0) if v == v else "nan"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if v is None:
        return "NULL"
    return type(v).__name__ + ":" + str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    t0 = time.time()
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t0
    if sql is None:
        return f"{name}: rows={len(got)} (no SQL) {spent:.1f}s", bool(got)
    t0 = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    raw = cur.fetchall()
    odd = [f"{c}:{t}" for c, t in zip(cols, types) if any(x in t for x in ("HUGEINT", "DECIMAL", "[]", "STRUCT", "UBIGINT", "MAP"))]
    want = rows_of(cols, raw)
    dspent = time.time() - t0
    note = f" ODD TYPES {odd}" if odd else ""
    if sorted(cols) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} vs {sorted(cols)}", False
    if got != want:
        gs, ws = set(got), set(want)
        extra = [r for r in got if r not in ws][:3]
        missing = [r for r in want if r not in gs][:3]
        return f"{name}: DIFF rows {len(got)} vs {len(want)}{note}\n  spark-only {extra}\n  sql-only   {missing}", False
    return f"{name}: ok rows={len(got)} spark {spent:.1f}s sql {dspent:.1f}s{note}", not odd and bool(got)


def main():
    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    q, o = e.queries(), e.oracle_sql()
    names = [n for n in q if not only or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in only)]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = []
    for n in names:
        try:
            msg, ok = check(spark, con, n, q[n], o.get(n), sf_dir)
        except Exception as ex:  # report and go on
            msg, ok = f"{n}: ERROR {type(ex).__name__} {str(ex)[:700]}", False
        print(msg, flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(names)} checked, {len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
