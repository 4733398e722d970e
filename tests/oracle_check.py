"""Run registered queries and their SQL twins side by side.

Usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype(str)
        elif s.dtype == object:
            df[c] = s.map(lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else v)
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].astype(float)
    df = df.astype(object).where(df.notna(), None)
    df = df.map(lambda v: "~" if v is None else (repr(float(v)) if isinstance(v, float) else str(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = _canon(spark_df), _canon(sql_df)
    for c in a.columns:
        kinds = [pd.api.types.is_float_dtype(x[c]) for x in (spark_df, sql_df)]
        if kinds[0] != kinds[1]:
            ints = [x[c] for x, k in zip((spark_df, sql_df), kinds) if not k]
            if not all(i.isna().any() or i.dtype == object for i in ints):
                pass
        bad = a[c] != b[c]
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} differ in {c}: {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from barloom.catalog import load
    from barloom.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    current = [""]

    def late(*_):
        print("LATE ", current[0], flush=True)
        os._exit(3)

    signal.signal(signal.SIGALRM, late)
    for name, (fn, sql) in load().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        signal.alarm(int(os.environ.get("QUERY_SECONDS", "150")))
        current[0] = name
        try:
            got = fn(spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:600]}")
            continue
        dt = time.time() - t0
        signal.alarm(0)
        if sql is None:
            print(f"rows  {name} {len(got)} {dt:.1f}s")
            continue
        t0 = time.time()
        try:
            want = con.execute(sql).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"SQLERR {name}: {str(e)[:800]}")
            continue
        diff = compare(got, want)
        bad += diff is not None
        print(f"{'ok   ' if diff is None else 'DIFF '} {name} {len(got)} {dt:.1f}s sql {time.time()-t0:.1f}s {diff or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
