"""Run registered queries next to their checking SQL: ``python tests/compare.py SF_DIR [name ...]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for name in sorted(df.columns):
        values = df[name]
        if pd.api.types.is_float_dtype(values):
            values = values.map(lambda v: "null" if pd.isna(v) else f"{v:.9g}")
        elif pd.api.types.is_datetime64_any_dtype(values):
            values = values.map(lambda v: "null" if pd.isna(v) else pd.Timestamp(v).isoformat())
        else:
            # as objects: whole numbers with nulls would pass through floats
            values = values.astype(object).map(lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and pd.isna(v))
                                else str(v))
        out[name] = values
    return out.sort_values(list(out.columns)).reset_index(drop=True) if len(out.columns) else out


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    # pandas turns Spark's whole numbers with nulls into floats; the frame's own schema tells them apart
    whole = {f.name for f in spark_df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")}
    kind = {c: "i" if c in whole and got[c].isna().any() else got[c].dtype.kind for c in got}
    kinds = [(c, kind[c], want[c].dtype.kind) for c in got if kind[c] != want[c].dtype.kind]
    a, b = normal(got), normal(want)
    if len(a) and not a.equals(b):
        bad = (a != b).any(axis=1)
        row = bad.idxmax()
        cols = [c for c in a if a.loc[row, c] != b.loc[row, c]]
        return f"{bad.sum()} of {len(a)} rows differ; {[(c, a.loc[row, c][:300], b.loc[row, c][:300]) for c in cols]}"
    return f"types {kinds}" if kinds else None


def main() -> None:
    from repolumen.plans import ORACLE, QUERIES
    from repolumen.session import get_spark

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = get_spark(cpus=8, **{"spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in names:
        began = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLE:
                result = difference(frame, con, ORACLE[name])
            else:
                result = None if len(frame.toPandas()) else "no rows"
            rows = con.execute(f"SELECT count(*) FROM ({ORACLE[name]})").fetchone()[0] if name in ORACLE else "-"
        except Exception as error:  # report every query, then fail
            result, rows = f"{type(error).__name__}: {str(error)[:400]}", "?"
        print(f"{'ok  ' if result is None else 'FAIL'} {name} rows={rows} {time.time() - began:.2f}s {result or ''}", flush=True)
        if result is not None:
            failed.append(name)
    print(f"{len(names) - len(failed)} ok, {len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
