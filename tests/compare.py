"""Run registered queries next to their check SQL and report differences.

    python tests/compare.py [folder] [name-substring ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
             "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, folder) -> str:
    df = fn(spark, folder)
    got_names = df.columns
    got = table([tuple(r) for r in df.collect()], got_names)
    if sql is None:
        return f"rows {len(got)}" if got else "EMPTY"
    con_types = con.execute(f"DESCRIBE {sql}").fetchall()
    want_names = [r[0] for r in con_types]
    if sorted(want_names) != sorted(got_names):
        return f"FAIL columns {sorted(got_names)} != {sorted(want_names)}"
    types = {r[0]: r[1] for r in con_types}
    bad_types = [(c, t, types[c]) for c, t in df.dtypes if DUCK_TYPE.get(t, t).lower() != types[c].lower()]
    want = table(con.execute(sql).fetchall(), want_names)
    if got != want:
        diff = [(g, w) for g, w in zip(got, want) if g != w]
        return (f"FAIL rows {len(got)} vs {len(want)}, {len(diff)} differ; columns {sorted(got_names)}; "
                f"first {diff[:2] if diff else (got[-1:], want[-1:])} {bad_types or ''}")
    if bad_types:
        return f"FAIL types {bad_types}"
    return f"ok {len(got)}" if got else "ok EMPTY"


def session(cores: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            res = compare(spark, con, name, fn, oracle.get(name), folder)
        except Exception as exc:  # noqa: BLE001
            res = "ERROR " + str(exc).replace("\n", " ")[:900]
        if not res.startswith(("ok ", "rows ")) or "EMPTY" in res:
            bad += 1
        print(f"{name:28s} {time.time() - t:5.1f}s {res}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
