"""Side-by-side run of registered queries and their reference SQL."""

import datetime
import decimal
import math
import os
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{folder}/{name}.parquet"):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def compare(con: duckdb.DuckDBPyConnection, df, sql: str) -> str | None:
    """NULL when both sides agree, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    ran = con.execute(sql)
    names = [d[0] for d in ran.description]
    want = rows_of(names, ran.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:2]
    lacking = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} / {len(want)}\n   spark only {extra}\n   sql only   {lacking}"


def main(folder: str, *patterns: str) -> None:
    from bizdata.plans import catalog
    from bizdata.plans.registry import ORACLES, QUERIES, runnable
    from bizdata.session import build

    del catalog
    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                        "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, build_query in QUERIES.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            df = runnable(build_query)(spark, folder)
            if name in ORACLES:
                verdict = compare(con, df, ORACLES[name])
                size = ""
            else:
                verdict, size = None, f" rows only: {df.count()}"
        except Exception as error:  # a broken query must not hide the others
            verdict, size = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += verdict is not None
        print(f"{'ok ' if verdict is None else 'BAD'} {name} {time.time() - start:.2f}s{size}" + (f"\n   {verdict}" if verdict else ""), flush=True)
    print(f"{bad} of {len(QUERIES)} differ")


if __name__ == "__main__":
    import sys

    main(*sys.argv[1:])
