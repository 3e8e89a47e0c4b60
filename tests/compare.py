"""Run registered queries next to their SQL in DuckDB: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def differences(df: DataFrame, con, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result, rows compared as multisets."""
    columns = sorted(df.columns)
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    if columns != sorted(row[0] for row in described):
        return [f"columns {columns} against {sorted(row[0] for row in described)}"]
    types = {row[0]: row[1] for row in described}
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
             "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    found = [f"type of {c}: {t} against {types[c]}" for c, t in df.dtypes if names.get(t, t.upper()) != types[c]]
    ours = Counter(tuple(row) for row in df.select(*columns).collect())
    listed = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(con.execute(f"SELECT {listed} FROM ({sql})").fetchall())
    if ours != theirs:
        found.append(f"{sum(ours.values())} rows against {sum(theirs.values())}")
        found += [f"only here: {row}" for row in list((ours - theirs).keys())[:2]]
        found += [f"only in SQL: {row}" for row in list((theirs - ours).keys())[:2]]
    return found


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, sql in entry.oracle_sql().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            found = differences(df, con, sql)
        except Exception as error:  # report and go on with the next query
            found = [str(error)[:1500]]
        bad += bool(found)
        print("FAIL" if found else "ok  ", name, f"{time.time() - start:.1f}s", *found, sep="  ", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
