"""Run registered queries against their SQL in DuckDB and compare schema and rows.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    """One comparable text per value, for both engines."""
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return str(int(value)) if value == value.to_integral_value() else format(value.normalize(), "f")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return "[" + ",".join(plain(item) for item in value) + "]"
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return "{" + ",".join(f"{key}:{plain(item)}" for key, item in sorted(value.items())) + "}"
    if hasattr(value, "replace") and hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(row[name]) for name in names) for row in df.select(*names).collect())


def duckdb_rows(sf_dir, sql):
    import duckdb

    from prefixlake.fixtures import BASE_TABLES

    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    given = [column[0] for column in cursor.description]
    rows = cursor.fetchall()
    names = sorted(given)
    places = [given.index(name) for name in names]
    return names, sorted(tuple(plain(row[i]) for i in places) for row in rows)


def compare(spark, sf_dir, build, sql):
    """Empty text when both agree, else a short account of the difference."""
    names, rows = spark_rows(build(spark, sf_dir))
    if sql is None:
        return "", len(rows)
    other_names, other = duckdb_rows(sf_dir, sql)
    if names != other_names:
        return f"columns {names} != {other_names}", len(rows)
    if rows != other:
        extra = sorted(set(rows) - set(other))[:2]
        missing = sorted(set(other) - set(rows))[:2]
        return f"rows {len(rows)} vs {len(other)}; spark only {extra}; sql only {missing}", len(rows)
    return "", len(rows)


def main(argv):
    import __spark_entry__ as entry
    from prefixlake.session import get_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session(
        "oracle-check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or list(queries):
        begun = time.time()
        try:
            problem, count = compare(spark, sf_dir, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", -1
        failed += bool(problem)
        kind = "" if name in oracles else " (no sql)"
        print(f"{'FAIL' if problem else 'ok  '} {name}{kind} rows={count} {time.time() - begun:.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
