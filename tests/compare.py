"""Run registered queries and their check SQL side by side and compare values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def _cell(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_cell(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


KINDS = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def compare(spark, con, sf, query, sql):
    df = query(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(names, cur.fetchall())
    assert got_cols == want_cols, f"columns {got_cols} != {want_cols}"
    for name, kind in df.dtypes:
        expected = KINDS.get(kind)
        assert expected is None or kinds[name] == expected, f"type of {name}: {kind} vs {kinds[name]}"
    assert len(got) == len(want), f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, f"{len(bad)} rows differ of {len(got)}, first: {bad[0]}"
    return len(got)


def main():
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from pixelloom.session import build_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    oracles = entry.oracle_sql()
    failed = []
    for name, query in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            if name in oracles:
                n = compare(spark, con, sf, query, oracles[name])
                note = f"ok {n} rows"
            else:
                note = f"rows only: {len(query(spark, sf).collect())}"
        except Exception as error:
            failed.append(name)
            text = str(error)
            note = "FAILED " + text[:1200]
        print(f"{name:34s} {time.time() - start:6.1f}s {note}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
