"""python tests/tools/run.py FOLDER QUERY...: time queries and compare them with their SQL in DuckDB."""

import sys
import tempfile
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, normal(x)) for k, x in v.items())
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(normal(r[i])) for i in order) for r in data)


def main() -> None:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='run-')}")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            got = [tuple(r) for r in df.collect()]
            took = time.time() - t
            note = "no SQL"
            if name in sql:
                rel = con.sql(sql[name])
                a, b = rows(df.columns, got), rows(rel.columns, rel.fetchall())
                note = "same" if a == b and sorted(df.columns) == sorted(rel.columns) else f"DIFFER {len(a)} {len(b)} only Spark {[x for x in a if x not in set(b)][:2]} only SQL {[x for x in b if x not in set(a)][:2]} {sorted(df.columns)} {sorted(rel.columns)}"
            print(f"{name}: {len(got)} rows, {took:.1f} s, {note}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:1500]}", flush=True)


if __name__ == "__main__":
    main()
