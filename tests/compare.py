"""Compare registered queries with their SQL oracle on the driver tables.

As a script: ``python -m tests.compare [sf] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str, parts: str = "") -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{parts}'")
    return con


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 9)
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides have the same columns, types of value and rows."""
    ours = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = rows(cols, cur.fetchall())
    if sorted(spark_df.columns) != sorted(cols):
        return f"columns {sorted(spark_df.columns)} != {sorted(cols)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(cols)}\n   ours   {a}\n   theirs {b}"
    kinds = {"TINYINT", "HUGEINT", "UINTEGER", "UBIGINT"}
    odd = [c[0] for c in cur.description if str(c[1]) in kinds]
    if odd:
        return f"oracle types {odd}"
    small = {n: t for n, t in spark_df.dtypes}
    for name, typ in [(c[0], str(c[1])) for c in cur.description]:
        want = {"BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double",
                "VARCHAR": "string"}.get(typ)
        if want and small[name] != want:
            return f"type of {name}: {small[name]} != {typ}"
    return None if ours else "no rows on either side"


def main(argv: list[str]) -> int:
    from __spark_entry__ import ALL as QUERIES
    from fleetlens.session import local_session

    sf = argv[0] if argv else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = argv[1:] or list(QUERIES)
    bad = 0
    for name in names:
        run, sql = QUERIES[name]
        start = time.time()
        try:
            df = run(spark, sf_dir)
            problem = difference(df, con, sql) if sql else (None if df.count() else "no rows")
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
