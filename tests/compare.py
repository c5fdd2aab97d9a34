"""Run registered queries beside their SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, int):
        return str(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def mismatch(spark, con, query, sql, sf_dir) -> str | None:
    """What differs between the query and its SQL, or None."""
    found = query(spark, sf_dir)
    left = rows_of(found.columns, [tuple(r) for r in found.collect()])
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    right = rows_of(columns, answer.fetchall())
    if sorted(found.columns) != sorted(columns):
        return f"columns {sorted(found.columns)} / {sorted(columns)}"
    if left != right:
        extra = [r for r in left if r not in set(right)][:2]
        lacking = [r for r in right if r not in set(left)][:2]
        return f"{len(left)} / {len(right)} rows; only here {extra}; only SQL {lacking}"
    return None if left else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from hearscore.session import build_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            problem = mismatch(spark, con, query, sqls[name], sf_dir)
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:28s} {time.time() - start:6.2f}s  {(problem or 'ok')[:1500]}", flush=True)
    print("mismatches:", bad)
