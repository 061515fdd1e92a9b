"""Runs the queries and their SQL side by side: python tests/oracle_check.py FOLDER [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].astype(object).where(out[c].notna(), None)
        out[c] = [None if v is None else (repr(float(v)) if isinstance(v, float) else str(v)) for v in out[c]]
    return out.sort_values(list(out.columns), na_position="first", kind="stable").reset_index(drop=True)


def differences(spark_df, sql: str, con) -> str | None:
    """None when columns, kinds and rows agree."""
    ours = spark_df.toPandas()
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    kinds = {c: (ours[c].dtype.kind, theirs[c].dtype.kind) for c in ours.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and {*k} - {"O"} and ours[c].notna().all()}
    a, b = _rows(ours), _rows(theirs)
    if not a.equals(b):
        bad = (a != b) & ~(a.isna() & b.isna())
        where = bad.any(axis=1)
        return f"{int(where.sum())} rows differ\n{a[where].head(3).to_string()}\n{b[where].head(3).to_string()}"
    return f"kinds {odd}" if odd else None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.session import session

    spark = session()
    con = duck(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                result = differences(query(spark, folder), sql[name], con)
            else:
                result = f"rows only: {query(spark, folder).count()}"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:1500]}"
        ok = result is None or result.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
