"""Run queries against their oracles: python tests/check.py [sf] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from repoweave.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    """Rows with columns in name order, sorted, in a form both engines agree on."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda r: tuple((v is not None, v) for v in r)
    )


def compare(spark, con, name, sf_dir):
    started = time.time()
    df = queries()[name](spark, sf_dir)
    got = df.collect()
    spark_seconds = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return None, len(got), spark_seconds, 0.0
    started = time.time()
    cursor = con.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    duck_seconds = time.time() - started
    mine = rows_of(df.columns, [tuple(r) for r in got])
    theirs = rows_of(expected_columns, expected)
    types = {c: str(t[1]) for c, t in zip(expected_columns, cursor.description)}
    if mine != theirs:
        print(name, mine[0], theirs[0], len(mine[1]), len(theirs[1]), types, df.dtypes)
        for a, b in zip(mine[1], theirs[1]):
            if a != b:
                print("  spark ", str(a)[:300])
                print("  oracle", str(b)[:300])
                break
    return mine == theirs, len(got), spark_seconds, duck_seconds


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    session = build_session(
        master="local[8]",
        conf={"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    connection = oracle_connection(folder)
    bad = []
    for query in sys.argv[2:] or queries():
        try:
            same, n, seconds, oracle_seconds = compare(session, connection, query, folder)
        except Exception as problem:  # noqa: BLE001
            same, n, seconds, oracle_seconds = False, -1, 0, 0
            print(query, type(problem).__name__, str(problem)[:600])
        print(f"{'ok  ' if same else 'rows' if same is None else 'BAD '} {query:32} {n:8} {seconds:7.2f}s {oracle_seconds:7.2f}s", flush=True)
        if same is False:
            bad.append(query)
    print("bad:", bad)
