"""Side-by-side check of a registered query against its DuckDB oracle.

Mirrors the driver's gate: row count, column names, and an order-insensitive
hash of the values. Used by the tests and runnable as a script:
``python -m millrun.plans.check /root/testdata/sf0.01 [name ...]``.
"""

from __future__ import annotations

import hashlib
import math
import sys

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


# Spark type -> DuckDB type name of the same result column.
DUCK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(float(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, bool):
        return str(v)
    return str(v)


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(str(_norm(r[i])) for i in order) for r in rows)
    return len(lines), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, sf_dir: str, name: str, con=None) -> dict:
    from millrun.plans.oracle import ORACLE
    from millrun.plans.queries import REGISTRY
    con = con or duck(sf_dir)
    sdf = REGISTRY[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    out = {"name": name, "spark_rows": len(s_rows)}
    if name not in ORACLE:
        out["oracle"] = None
        return out
    res = con.execute(ORACLE[name])
    d_cols = [c[0] for c in res.description]
    d_types = {c[0]: str(c[1]) for c in res.description}
    d_rows = res.fetchall()
    out.update(oracle_rows=len(d_rows), columns_match=sorted(s_cols) == sorted(d_cols))
    s_types = {f.name: DUCK_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
               for f in sdf.schema.fields}
    type_diff = {k: (s_types[k], d_types.get(k)) for k in s_types if s_types[k] != d_types.get(k)}
    out["types_match"] = not type_diff
    if type_diff:
        out["types"] = type_diff
    if not out["columns_match"]:
        out["columns"] = (s_cols, d_cols)
    s_dig, d_dig = digest(s_cols, s_rows), digest(d_cols, d_rows)
    out["hash_match"] = s_dig == d_dig
    if not out["hash_match"] and out["columns_match"]:
        order_s = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
        order_d = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
        a = sorted("|".join(str(_norm(r[i])) for i in order_s) for r in s_rows)
        b = sorted("|".join(str(_norm(r[i])) for i in order_d) for r in d_rows)
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:3]
        out["only_oracle"] = [x for x in b if x not in sa][:3]
        out["cols"] = sorted(s_cols)
    return out


def main(argv):
    from millrun.plans.queries import REGISTRY
    from millrun.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(REGISTRY)
    spark = get_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        r = compare(spark, sf_dir, n, con)
        ok = r.get("hash_match", r.get("oracle", 1) is None) and r.get("types_match", True)
        bad += not ok
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
