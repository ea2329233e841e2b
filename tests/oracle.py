"""Compare a registered query with its SQL oracle the way the driver does: columns by name, rows as a multiset."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from evidencelake.plans.registry import TABLES


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{root}/{t}.parquet')")
    return con


def canonical(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=repr)


def strict_types(df_schema, description):
    """Spark and DuckDB types that would not compare as the same kind."""
    spark = {f.name: f.dataType.simpleString() for f in df_schema.fields}
    kinds = {}
    for d in description:
        kinds[d[0]] = str(d[1])
    bad = []
    for name, s in spark.items():
        d = kinds.get(name, "?")
        group = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "smallint": "SMALLINT"}
        if group.get(s) != d.upper() and not (s == "string" and d.upper() in ("STRING", "VARCHAR")):
            bad.append((name, s, d))
    return bad


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cols = spark_df.columns
    got = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = strict_types(spark_df.schema, rel.description)
    want = rows_of(names, rel.fetchall())
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} sql {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"values {sorted(cols)}: {g} != {w}"
    if types:
        return f"types {types}"
    return None if got else "no rows"
