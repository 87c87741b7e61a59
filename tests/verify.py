"""python tests/verify.py FOLDER [NAME...]: each query beside its DuckDB SQL; prints rows, seconds and the outcome."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def cell(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(cell(x) for x in (v.tolist() if hasattr(v, "tolist") else v))
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return str(v) if not isinstance(v, (int, str, bool)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr(tuple(cell(r[i]) for i in order)) for r in rows))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def compare(spark, con, name, query, sql, folder):
    t = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - t
    if sql is None:
        return f"{name}: {len(got)} rows, {took:.1f} s, no SQL"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: COLUMNS DIFFER {sorted(df.columns)} {sorted(names)}"
    if got == want:
        return f"{name}: equal, {len(got)} rows, {took:.1f} s"
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{name}: DIFFERS {len(got)} / {len(want)} rows; only Spark {len(a)}: {sorted(a)[:3]}; only SQL {len(b)}: {sorted(b)[:3]}"


def main() -> None:
    import __spark_entry__ as e
    from tests.conftest import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark, con, sql = session(), connect(folder), e.oracle_sql()
    for name, q in e.queries().items():
        if not names or name in names or any(n.endswith("*") and name.startswith(n[:-1]) for n in names):
            try:
                print(compare(spark, con, name, q, sql.get(name), folder), flush=True)
            except Exception as x:
                print(f"{name}: ERROR {str(x)[:600]}", flush=True)


if __name__ == "__main__":
    main()
