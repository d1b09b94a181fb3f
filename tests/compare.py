"""Compares a registered query with its SQL twin, the way the driver does."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP", "date": "DATE", "array<string>": "VARCHAR[]",
    "array<bigint>": "BIGINT[]",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def compare(df, sql: str, con) -> list[str]:
    """Differences as text; empty when both sides agree."""
    result = con.execute(sql)
    duck_cols = [d[0] for d in result.description]
    duck_types = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    mine = df.collect()
    problems = []
    if sorted(df.columns) != sorted(duck_cols):
        return [f"columns {sorted(df.columns)} vs {sorted(duck_cols)}"]
    for name, kind in df.dtypes:
        if SPARK_TO_DUCK.get(kind) != duck_types[name]:
            problems.append(f"type of {name}: {kind} vs {duck_types[name]}")
    names = sorted(df.columns)
    order = [duck_cols.index(n) for n in names]
    left = Counter(tuple(_plain(row[n]) for n in names) for row in mine)
    right = Counter(tuple(_plain(row[i]) for i in order) for row in theirs)
    if left != right:
        problems.append(f"rows {len(mine)} vs {len(theirs)}")
        problems += [f"  only spark: {r}"[:400] for r in list((left - right))[:3]]
        problems += [f"  only sql:   {r}"[:400] for r in list((right - left))[:3]]
    elif not mine:
        problems.append("no rows on either side")
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracles:
                problems = compare(df, oracles[name], con)
                label = "ok" if not problems else "DIFF"
            else:
                problems, label = [], f"rows={df.count()}"
        except Exception as error:  # report and go on with the next query
            problems, label = [str(error)[:500]], "FAIL"
        bad += bool(problems)
        print(f"{label:6} {name} {time.time() - start:.1f}s", flush=True)
        for line in problems:
            print("    ", line)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
