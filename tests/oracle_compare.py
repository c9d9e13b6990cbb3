"""Run a registered Spark query and its DuckDB oracle side by side.

Mirrors the driver's gate: row count, column names, and an order-insensitive
hash of the values (columns sorted by name). Usable as a script:

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v.to_integral() else str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    return str(v)


def table_hash(df: pd.DataFrame) -> str:
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def rows_of(df: pd.DataFrame) -> list[str]:
    cols = sorted(df.columns)
    return sorted("|".join(_norm(r[c]) for c in cols) for r in df.to_dict("records"))


def spark_rows(sdf) -> pd.DataFrame:
    rows = sdf.collect()
    return pd.DataFrame([r.asDict() for r in rows], columns=sdf.columns, dtype=object)


def duck_rows(con, sql: str) -> pd.DataFrame:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return pd.DataFrame(cur.fetchall(), columns=names, dtype=object)


def compare(spark, sf_dir: str, name: str, fn, sql: str | None, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    s = spark_rows(fn(spark, sf_dir))
    t1 = time.time()
    out = {"name": name, "spark_rows": len(s), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["match"] = None
        return out
    d = duck_rows(con, sql)
    out["oracle_rows"] = len(d)
    out["columns_match"] = sorted(s.columns) == sorted(d.columns)
    out["hash_match"] = out["columns_match"] and table_hash(s) == table_hash(d)
    out["match"] = out["hash_match"] and len(s) == len(d)
    if not out["match"]:
        out["spark_cols"] = list(s.columns)
        out["oracle_cols"] = list(d.columns)
        if out["columns_match"]:
            rs, rd = set(rows_of(s)), set(rows_of(d))
            out["only_spark"] = sorted(rs - rd)[:3]
            out["only_oracle"] = sorted(rd - rs)[:3]
    return out


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from starcart.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = local_session()
    qs = entry.queries()
    sqls = entry.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or list(qs):
        r = compare(spark, sf_dir, name, qs[name], sqls.get(name), con)
        bad += r["match"] is False
        print(r, flush=True)
    print(f"mismatches: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
