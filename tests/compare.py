"""Run a registered query next to its SQL oracle and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def _families(types):
    """Integers, floats, texts and booleans: the part of a type both engines share."""
    names = []
    for t in types:
        t = str(t).lower()
        if "int" in t or t in ("long", "hugeint"):
            names.append("hugeint" if "huge" in t else "int")
        elif t.startswith(("double", "float")):
            names.append("double")
        elif t.startswith("decimal"):
            names.append("decimal")
        elif t in ("varchar", "string"):
            names.append("string")
        else:
            names.append(t)
    return names


def compare(df, connection, sql: str) -> str | None:
    """None when equal, else what differs."""
    found_columns, found = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    wanted_columns, wanted = _rows(names, result.fetchall())
    if found_columns != wanted_columns:
        return f"columns {found_columns} != {wanted_columns}"
    relation = connection.sql(sql)
    found_types = dict(zip(df.columns, _families(f.dataType.simpleString() for f in df.schema)))
    wanted_types = dict(zip(relation.columns, _families(relation.types)))
    if found_types != wanted_types:
        diff = {c: (found_types[c], wanted_types[c]) for c in names if found_types[c] != wanted_types[c]}
        return f"types {diff}"
    if len(found) != len(wanted):
        return f"{len(found)} rows != {len(wanted)}"
    for left, right in zip(found, wanted):
        if left != right:
            return f"row {left} != {right}"
    return None
