"""Runs registered queries on Spark and their SQL on DuckDB, and compares rows and types."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import re
import sys
import time

import duckdb

from dealtide.plans import BASE_TABLES, ORACLES, QUERIES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    return repr(value)


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in records])


def kinds(columns, types):
    short = {
        "bigint": "int", "int": "int", "integer": "int", "hugeint": "int", "varchar": "string", "double": "double",
        "float": "double", "boolean": "bool", "timestamp_ntz": "timestamp", "smallint": "int",
    }
    names = [str(t).lower() for t in types]
    names = [re.sub(r"^array<string>$", "varchar[]", t) for t in names]
    return {c: short.get(t, t.split("(")[0]) for c, t in zip(columns, names)}


def compare(spark, con, sf_dir, name):
    """None when equal, else a description of the first differences."""
    frame = QUERIES[name](spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    ours = kinds(frame.columns, [f.dataType.simpleString() for f in frame.schema.fields])
    theirs = kinds(columns, [d[1] for d in result.description])
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    if ours != theirs:
        odd = {c: (ours[c], theirs[c]) for c in ours if ours[c] != theirs[c]}
        return f"TYPES {odd}"
    return None if want else "EMPTY"


def main(argv):
    from dealtide.session import build_session

    sf_dir = argv[0]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = [n for n in QUERIES if len(argv) == 1 or any(n.startswith(a) for a in argv[1:])]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, sf_dir, name)
            else:
                verdict = f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {str(error)[:700]}"
        if verdict and not verdict.startswith("rows only"):
            bad += 1
        print(f"{name:34s} {time.time() - start:6.2f}s {verdict or 'ok'}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine")


if __name__ == "__main__":
    main(sys.argv[1:])
