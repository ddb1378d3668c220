"""Run registered queries beside their SQL text in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark"
    " labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 9) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def compare(spark, con, name, fn, sql, sf) -> str | None:
    df = fn(spark, sf)
    got_names = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in got_names) for r in df.collect()]
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != got_names:
        return f"columns {got_names} != {sorted(names)}"
    kinds = {d[0]: str(d[1]) for d in cur.description}
    for c in got_names:
        a, b = df.schema[c].dataType.simpleString(), kinds[c]
        same = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER", "date": "DATE"}
        if same.get(a) != b and not (a == "string" and b == "STRING") and not (a == "boolean" and b == "BOOL"):
            print(f"   type note {name}.{c}: {a} vs {b}")
    at = [names.index(c) for c in got_names]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    if Counter(got) != Counter(want):
        a, b = Counter(got), Counter(want)
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"rows {len(got)} vs {len(want)}; cols {got_names}; spark only {only_a}; sql only {only_b}"
    return None if got else "equal but EMPTY"


def main(sf: str, prefixes: list[str]) -> int:
    sys.path.insert(0, "/root/repo")
    from spanweave.plans import registry
    from spanweave.session import build_session

    registry.load_all()
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not any(name == p or (p.endswith("*") and name.startswith(p[:-1])) for p in prefixes):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, registry.SQL_TEXT.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            text = str(exc)
            problem = f"{type(exc).__name__}: {text[:900]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
