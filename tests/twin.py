"""Compare registered queries with their SQL twins: ``python tests/twin.py [sf] [name-prefix ...]``."""

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"


def connect(path):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(path)):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, path, name, check):
    started = time.time()
    df = check.run(spark, path)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if check.sql is None:
        return seconds, len(got), "rows-only" if got else "EMPTY"
    cur = con.execute(check.sql)
    tcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    twin = time.time() - started - seconds
    if sorted(cols) != sorted(tcols):
        return seconds, len(got), f"COLUMNS {sorted(cols)} vs {sorted(tcols)}"
    a, b = rows_of(cols, got), rows_of(tcols, want)
    if not a:
        return seconds, 0, "EMPTY"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return seconds, len(got), f"DIFF {len(a)} vs {len(b)} first {bad}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    odd = [(d[0], types[d[0]], str(d[1])) for d in cur.description if not same_type(types[d[0]], str(d[1]))]
    return seconds, len(got), "ok" + (f" twin {twin:.1f}s" if twin > 2 else "") + (f" TYPES {odd}" if odd else "")


def same_type(s, t):
    table = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return table.get(s, s) == t or s.startswith(("timestamp", "array", "map", "struct", "date"))


def main():
    from photospark.checks import load_checks
    from photospark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    path = f"{ROOT}/{sf}"
    spark = build_session("twins", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(path)
    bad = 0
    for name, item in load_checks().items():
        if wanted and not any(name == w or name.startswith(w) for w in wanted):
            continue
        try:
            seconds, n, verdict = compare(spark, con, path, name, item)
        except Exception as error:  # report and go on
            seconds, n, verdict = 0, 0, "ERROR " + str(error)[:700].replace("\n", " | ")
        ok = verdict.startswith(("ok", "rows-only")) and "TYPES" not in verdict
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name:32s} {seconds:6.1f}s {n:7d} {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
