"""Compare registered queries with their SQL oracles the way the driver does."""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connection(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}" if v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = normalise([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1])
    if got[1] != want[1]:
        g, w = set(got[1]), set(want[1])
        return (f"rows {len(got[1])} vs {len(want[1])}; spark only {sorted(g - w)[:2]}; "
                f"sql only {sorted(w - g)[:2]}"), len(got[1])
    return None, len(got[1])


def main():
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from docloom.session import build_session

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session(cores="8")
    con = duck_connection(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem, n = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                problem, n = None, query(spark, sf_dir).count()
        except Exception as exc:  # report and go on with the next query
            problem, n = f"{type(exc).__name__}: {str(exc)[:700]}", -1
        kind = "sql " if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {n:7d} {time.time() - start:6.2f}s {problem or ''}",
              flush=True)


if __name__ == "__main__":
    main()
