"""Run registered queries and their SQL on one scale folder and compare all rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES
from tickertide.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return round(number, 6) + 0.0
    return str(value)[:10] if hasattr(value, "year") else str(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def main(argv: list[str]) -> int:
    sf_dir, names = argv[0], argv[1:] or list(QUERIES)
    spark = build_session(
        "compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                  "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            start = time.time()
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - start
            if name not in ORACLE:
                print(f"rows {name}: {len(got)} rows, {took:.2f}s", flush=True)
                continue
            cur = con.execute(ORACLE[name])
            cols = [c[0] for c in cur.description]
            want = rows_of(cols, cur.fetchall())
            same = sorted(cols) == sorted(df.columns) and got == want
            print(f"{'ok  ' if same else 'DIFF'} {name}: {len(got)} rows, {took:.2f}s", flush=True)
            if not same:
                bad += 1
                print("   columns", sorted(cols), sorted(df.columns), "rows", len(want))
                for g, w in [(g, w) for g, w in zip(got, want) if g != w][:2]:
                    print("   spark", str(g)[:600], "\n   sql  ", str(w)[:600])
        except Exception as exc:
            bad += 1
            print(f"FAIL {name}: {str(exc)[:700]}", flush=True)
            if "-v" in sys.argv:
                traceback.print_exc()
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main([a for a in sys.argv[1:] if a != "-v"]))
