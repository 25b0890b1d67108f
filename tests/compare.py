"""Runs queries in Spark and their SQL in DuckDB, and compares the rows."""

import datetime
import decimal
import math
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return repr(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([[value(r[i]) for i in order] for r in data])


def differs(spark, sf_dir, query, sql):
    """Nothing if the two agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    only = [r for r in got[1] if r not in want[1]][:2], [r for r in want[1] if r not in got[1]][:2]
    return f"{len(got[1])} and {len(want[1])} rows; only in one: {only}"


if __name__ == "__main__":
    from conftest import session

    sys.path.insert(0, ".")
    import __spark_entry__ as entry

    spark, sql, bad = session(), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        if not len(sys.argv) > 2 and (name.startswith("op") or name == "pipeline"):
            continue
        try:
            said = differs(spark, sys.argv[1], query, sql[name]) if name in sql else f"rows only: {query(spark, sys.argv[1]).count()}"
        except Exception as e:
            said = f"failed: {str(e)[:400]}"
        if said:
            print(name, said[:600], flush=True)
