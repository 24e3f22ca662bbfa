"""Run registered queries next to their SQL and compare the results.

    python tests/compare.py [sf_dir] [name ...]
"""

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    return con


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if v != v:
            return "NULL"
        return repr(round(v, 9))
    return str(v)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, query, sql, sf):
    frame = query(spark, sf)
    got_cols, got = table_rows(frame.columns, [tuple(r) for r in frame.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    result = con.execute(sql)
    want_cols, want = table_rows([d[0] for d in result.description], result.fetchall())
    types = {d[0]: str(d[1]) for d in result.description}
    mine = dict(frame.dtypes)
    family = {"double": ("DOUBLE", "FLOAT"), "bigint": ("BIGINT",), "int": ("INTEGER",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    if got_cols != want_cols:
        return f"COLUMNS {got_cols} != {want_cols}"
    odd = [f"{c}:{mine[c]}/{types[c]}" for c in got_cols if not types[c].upper().startswith(family.get(mine[c], ("",)))]
    note = f" types {odd}" if odd else ""
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}{note}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"VALUES differ in {len(bad)} of {len(got)}: {got_cols} {bad[:2]}{note}"
    return f"ok {len(got)}{note}"


def main():
    from studyframe.plans import load
    from studyframe.session import study_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracle = load()
    names = sys.argv[2:] or list(queries)
    spark = study_session(
        "compare", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
           "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in names:
        start = time.time()
        try:
            verdict = check(spark, con, name, queries[name], oracle.get(name), sf)
        except Exception as error:  # report and go on with the next query
            verdict = "ERROR " + str(error)[:700].replace("\n", " ")
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if not verdict.startswith(("ok", "rows-only")) or "types" in verdict:
            failed.append(name)
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
