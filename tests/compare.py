"""Run registered queries and their SQL counterparts side by side.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    return str(v)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(df, con, sql: str) -> list[str]:
    """Differences as text lines; empty when both sides agree."""
    problems = []
    rel = con.execute(f"DESCRIBE {sql}").fetchall()
    duck_types = {r[0]: r[1] for r in rel}
    spark_types = dict(df.dtypes)
    if set(duck_types) != set(spark_types):
        return [f"columns differ: spark {sorted(spark_types)} duck {sorted(duck_types)}"]
    for c, t in spark_types.items():
        if TYPES.get(t, duck_types[c]) != duck_types[c]:
            problems.append(f"type of {c}: spark {t} duck {duck_types[c]}")
    cols = sorted(spark_types)
    t0 = time.time()
    left = sorted(tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    t1 = time.time()
    right = sorted(
        tuple(_norm(v) for v in r)
        for r in con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) q").fetchall()
    )
    print(f"   spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s", end=" ")
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} duck {len(right)}")
    if left != right:
        a, b = set(left), set(right)
        problems.append(f"values differ {cols}\n   spark only {sorted(a - b)[:3]}\n   duck only  {sorted(b - a)[:3]}")
    if not left:
        problems.append("no rows")
    return problems


def main() -> None:
    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    import __spark_entry__ as entry
    from sheetloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    qs, texts = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in texts:
                problems = compare(df, con, texts[name])
            else:
                problems = [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.1f}s {'' if name in texts else '(rows only)'}", flush=True)
        for p in problems:
            print("    ", p, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
