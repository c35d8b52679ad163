"""Run queries() on Spark and oracle_sql() on DuckDB over one scale-factor directory and
compare row count, column names and an order-insensitive value digest.

    python tests/oracle_check.py /root/testdata/sf0.01 [name ...]
"""
from __future__ import annotations

import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


EXACT = os.environ.get("ORACLE_EXACT") == "1"


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if EXACT else f"{round(v, 6):.6f}"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


_DUCK_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
               "BOOLEAN": "boolean", "DATE": "date", "FLOAT": "float", "TIMESTAMP": "timestamp"}


def duck_type(t) -> str:
    t = str(t)
    if t.endswith("[]"):
        return f"array<{duck_type(t[:-2])}>"
    if t.startswith("DECIMAL"):
        return t.lower().replace(" ", "")
    return _DUCK_TYPES.get(t, t.lower())


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(sf_dir, names=None, spark=None, verbose=True):
    import __spark_entry__ as E
    from merchantry.session import local_session
    spark = spark or local_session()
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            sdf = qs[name](spark, sf_dir)
            scols = sdf.columns
            stypes = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", repr(e)[:400])
            if verbose:
                print(name, "SPARK_ERROR", repr(e)[:800], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = ("NO_ORACLE", len(srows))
            if verbose:
                print(f"{name}: rows={len(srows)} (no oracle) {ts:.1f}s", flush=True)
            continue
        try:
            rel = con.sql(sqls[name])
            dtypes = {c: duck_type(t) for c, t in zip(rel.columns, rel.types)}
            dcols = list(rel.columns)
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("SQL_ERROR", repr(e)[:400])
            if verbose:
                print(name, "SQL_ERROR", repr(e)[:1500], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_types = stypes == dtypes
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = ok_cols and len(srows) == len(drows) and hs == hd
        results[name] = ("OK" if ok else "MISMATCH", len(srows), len(drows))
        if verbose:
            print(f"{name}: {'OK' if ok else 'MISMATCH'} rows spark={len(srows)} duck={len(drows)} "
                  f"cols_ok={ok_cols} types_ok={ok_types} {ts:.1f}s", flush=True)
            if not ok:
                if not ok_cols:
                    print("  spark cols", sorted(scols), "\n  duck cols ", sorted(dcols))
                sd = sorted(set(ls) - set(ld))[:5]
                dd = sorted(set(ld) - set(ls))[:5]
                for x in sd:
                    print("  spark-only:", x[:300])
                for x in dd:
                    print("  duck-only: ", x[:300])
    return results


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:] or None)
