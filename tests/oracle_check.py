"""Run registered queries against their SQL twins in DuckDB and compare every value.

    python tests/oracle_check.py [sf] [name or prefix ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sort_key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=sort_key)


def duck_rows(connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    return [names[i] for i in order], sorted(rows, key=sort_key), types


def connect(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def difference(spark_df, connection, sql):
    """(None when equal, otherwise a short description; seconds the oracle took)."""
    columns, rows = spark_rows(spark_df)
    start = time.time()
    names, wanted, types = duck_rows(connection, sql)
    return mismatch(spark_df, columns, rows, names, wanted, types), time.time() - start


def mismatch(spark_df, columns, rows, names, wanted, types):
    if columns != names:
        return f"columns {columns} != {names}"
    if len(rows) != len(wanted):
        return f"{len(rows)} rows, expected {len(wanted)}"
    for mine, other in zip(rows, wanted):
        if mine != other:
            return f"row differs: {[(c, x, y) for c, x, y in zip(columns, mine, other) if x != y]}"
    kind = {"bigint": "NUMBER", "int": "NUMBER", "double": "NUMBER", "string": "STRING", "boolean": "bool"}
    exact = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, dtype in spark_df.dtypes:
        if dtype in kind and types[name] not in (exact[dtype], kind[dtype]):
            return f"type of {name}: {dtype} against {types[name]}"
    return None


def main():
    import __spark_entry__ as entry

    from panelscore.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem, seconds = difference(df, connection, oracles[name])
                extra = f"(oracle {seconds:.2f}s) "
            else:
                problem, extra = None, f"rows-only {df.count()}"
        except Exception as exc:  # report and go on with the next query
            problem, extra = f"{type(exc).__name__}: {str(exc)[:600]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:26s} {time.time() - start:6.2f}s {extra}{problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
