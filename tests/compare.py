"""Run catalogue queries next to their SQL and report differences (also a command-line tool)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


SAME_TYPE = {"int": "INTEGER", "string": "VARCHAR"}


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def differences(spark, con, sf: str, function, sql: str) -> list[str]:
    df = function(spark, sf)
    names = sorted(df.columns)
    ours = _sorted([tuple(_plain(r[n]) for n in names) for r in df.collect()])
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(sql_names) != names:
        return [f"columns {names} / {sorted(sql_names)}"]
    order = [sql_names.index(n) for n in names]
    types = {d[0]: str(d[1]).upper() for d in cur.description}
    odd = [
        f"{n}: {t} / {types[n]}" for n, t in df.dtypes if SAME_TYPE.get(t, t.upper()) != types[n]
    ]
    theirs = _sorted([tuple(_plain(r[i]) for i in order) for r in cur.fetchall()])
    found = [f"types {odd}"] if odd else []
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} / {len(theirs)}")
    if ours != theirs:
        a, b = set(map(repr, ours)), set(map(repr, theirs))
        left, right = sorted(a - b), sorted(b - a)
        if left or right:
            found.append(f"{len(left)} / {len(right)} rows differ, e.g. {left[:2]} / {right[:2]}"[:600])
    return found


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from postlab.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    session = build_session(master="local[8]", shuffle_partitions=8,
                            **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                               "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, function in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                result = differences(session, con, sf_dir, function, sqls[name]) or "ok"
            else:
                result = f"no SQL, {len(function(session, sf_dir).collect())} rows"
        except Exception as error:  # report and go on
            result = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        print(f"{name:32s} {time.time() - start:6.1f}s {result}", flush=True)
