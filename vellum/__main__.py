"""python -m vellum list | run NAME --data DIR [--out DIR] | sql NAME | compare NAME --data DIR"""

from __future__ import annotations

import argparse
import glob
import os
import sys

from . import catalog


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vellum").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def told(columns: list[str], rows: list) -> list[tuple]:
    """Rows in an order of their own, their columns by name, numbers to six places."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in order) for r in rows)


def compare(name: str, data: str) -> bool:
    """Whether a query gives the rows of its SQL in DuckDB. For small data: both results are gathered."""
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{data}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    df, want = catalog.queries()[name](session(), data), con.sql(catalog.oracle_sql()[name])
    return sorted(df.columns) == sorted(want.columns) and told(df.columns, df.collect()) == told(want.columns, want.fetchall())


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    parser.add_argument("what", choices=["list", "run", "sql", "compare"])
    parser.add_argument("name", nargs="?", choices=sorted(catalog.queries()), metavar="NAME")
    parser.add_argument("--data", help="folder of the tables, as Parquet")
    parser.add_argument("--out", help="folder for the result, as Parquet; without it the first rows are shown")
    a = parser.parse_args(arguments)
    if a.what == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    if a.name is None or a.what != "sql" and not a.data:
        parser.error("a name, and --data except for sql, are needed")
    if a.what == "sql":
        print(catalog.oracle_sql().get(a.name, "no SQL gives these rows"))
        return 0
    if a.what == "compare":
        same = compare(a.name, a.data)
        print("same rows" if same else "other rows")
        return 0 if same else 1
    df = catalog.queries()[a.name](session(), a.data)
    if a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
