"""Compare registered queries with their SQL twins: ``python -m tests.check [name ...]``."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

import duckdb

from testbed.queries import ORACLES, QUERIES
from tests.conftest import make_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def differences(spark_rows, names, oracle_rows, oracle_names) -> str | None:
    if sorted(names) != sorted(oracle_names):
        return f"columns differ: {sorted(set(names) ^ set(oracle_names))}"
    order = [oracle_names.index(name) for name in names]
    ours = Counter(tuple(row) for row in spark_rows)
    theirs = Counter(tuple(row[i] for i in order) for row in oracle_rows)
    if ours == theirs:
        return None
    extra, missing = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
    return f"{ours.total()} rows vs {theirs.total()}; only ours {extra}; only SQL {missing}"


def check(spark, connection, name: str, folder: str) -> tuple[str | None, int]:
    frame = QUERIES[name](spark, folder)
    rows = [tuple(row) for row in frame.collect()]
    if name not in ORACLES:
        return (None if rows else "no rows"), len(rows)
    cursor = connection.execute(ORACLES[name])
    names = [column[0] for column in cursor.description]
    types = {column[0]: str(column[1]) for column in cursor.description}
    wide = [column for column, kind in types.items() if "HUGEINT" in kind]
    if wide:
        return f"HUGEINT columns {wide}", len(rows)
    return differences(rows, frame.columns, cursor.fetchall(), names), len(rows)


def main() -> None:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark, connection = make_session(), connect(folder)
    wanted = sys.argv[1:] or list(QUERIES)
    failed = 0
    for name in wanted:
        start = time.time()
        try:
            problem, rows = check(spark, connection, name, folder)
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:600]}", 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={rows} {time.time() - start:.1f}s "
              f"{problem or ''}", flush=True)
    print(f"{len(wanted) - failed}/{len(wanted)} ok")


if __name__ == "__main__":
    main()
