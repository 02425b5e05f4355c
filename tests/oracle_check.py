"""Run registered queries and their SQL side by side on one folder."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0) if value else "0.0"
    return repr(value)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, folder: str, build, sql: str) -> str:
    """Empty when equal, else what differs."""
    df = build(spark, folder)
    ours = as_rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = as_rows(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else ""


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from ratewright.session import local_session

    folder = sys.argv[1]
    chosen = set(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = connect(folder), entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in oracle:
                wrong = compare(spark, con, folder, build, oracle[name])
            else:
                wrong = f"(rows only: {build(spark, folder).count()})"
        except Exception as error:  # noqa: BLE001
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(wrong)
        print(f"{name:36s} {time.time() - start:6.2f}s {wrong or 'ok'}", flush=True)
    print("not ok:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
