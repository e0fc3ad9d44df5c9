"""Run registered queries against their DuckDB twins.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
# DuckDB type -> the Spark types it may stand for
TYPES = {"VARCHAR": {"string"}, "BIGINT": {"bigint"}, "INTEGER": {"int"}, "DOUBLE": {"double"}, "BOOLEAN": {"boolean"},
         "NULL": {"string"}}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def difference(df, con, sql) -> str:
    """Empty when both sides agree on names, types and the bag of rows."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: str(c[1]).upper() for c in result.description}
    rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    for name, kind in df.dtypes:
        if kind not in TYPES.get(types[name], {kind}) and rows:
            return f"type of {name}: {kind} against {types[name]}"
    mine, theirs = lines(df.columns, df.collect()), lines(names, rows)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sum(x != y for x, y in zip(mine, theirs))} differ: " + str([(x, y) for x, y in zip(a, b) if x != y])[:600]
    return "" if mine else "no rows"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from abacist.session import build

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, todo, oracle = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or todo:
        start = time.time()
        try:
            df = todo[name](spark, sf_dir)
            note = difference(df, con, oracle[name]) if name in oracle else f"rows only: {len(df.collect())}"
        except Exception as error:  # report every query before failing
            note = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(note) and not note.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.2f}s {note or 'ok'}", flush=True)
    print("failed:", bad, "of", len(sys.argv[2:] or todo))
    sys.exit(bad > 0)
