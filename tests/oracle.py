"""Runs registered queries beside their check SQL on DuckDB."""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


KINDS = {
    "bigint": "i64", "int": "i32", "integer": "i32", "double": "f64", "string": "str",
    "varchar": "str", "boolean": "bool", "timestamp": "ts", "timestamp_ntz": "ts", "tinyint": "i8", "smallint": "i16",
    "hugeint": "i128", "float": "f32", "date": "date",
}


def kind(t: str) -> str:
    t = t.lower()
    return KINDS.get(t, t)


def compare(spark, con, name, sf_dir):
    from ruleloom.plans import QUERIES

    q = QUERIES[name]
    t0 = time.time()
    df = q.run(spark, sf_dir)
    got_rows = df.collect()
    secs = time.time() - t0
    names, got = rows_of(df.columns, got_rows)
    if q.sql is None:
        return secs, len(got), "rows-only" if got else "EMPTY"
    res = con.execute(q.sql)
    cols = [d[0] for d in res.description]
    want_names, want = rows_of(cols, res.fetchall())
    if names != want_names:
        return secs, len(got), f"COLUMNS {names} != {want_names}"
    types = {n: kind(t) for n, t in df.dtypes}
    sql_types = {d[0]: kind(str(d[1])) for d in res.description}
    bad = {n: (types[n], sql_types[n]) for n in names if types[n] != sql_types[n]}
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 20000 else []
        missing = [r for r in want if r not in set(got)][:3] if len(want) < 20000 else []
        return secs, len(got), f"VALUES {len(got)} vs {len(want)} extra={extra} missing={missing}"
    if bad:
        return secs, len(got), f"TYPES {bad}"
    return secs, len(got), "ok" if got else "EMPTY"


def main() -> int:
    from ruleloom.plans import QUERIES
    from ruleloom.session import build_session

    sf_dir = "/root/testdata/sf0.01"
    args = sys.argv[1:]
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    spark = build_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        try:
            secs, rows, state = compare(spark, con, n, sf_dir)
        except Exception as e:  # report and go on with the next query
            secs, rows, state = 0, 0, "ERROR " + str(e).split("JVM stacktrace")[0][:600]
        if state not in ("ok", "rows-only"):
            bad += 1
        print(f"{n:40s} {secs:6.2f}s {rows:7d} {state}", flush=True)
    print(f"{len(names)} queries, {bad} not ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
