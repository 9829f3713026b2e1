"""Run a query and its SQL twin on the same folder and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark_df, sql: str, con, show: int = 4) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(names)}"
    actual = rows_of(spark_df.columns, spark_df.collect())
    if actual != expected:
        left = [r for r in actual if r not in set(expected)] if len(actual) < 50000 else []
        right = [r for r in expected if r not in set(actual)] if len(actual) < 50000 else []
        return (f"{len(actual)} vs {len(expected)} rows; columns {sorted(names)}\n"
                f"  only here {len(left)}: {left[:show]}\n  only in sql {len(right)}: {right[:show]}")
    spark_types = dict(spark_df.dtypes)
    wanted = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
              "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (spark_types[n], types[n]) for n in names
           if spark_types[n] in wanted and wanted[spark_types[n]] != types[n]}
    return f"types differ: {odd}" if odd else None
