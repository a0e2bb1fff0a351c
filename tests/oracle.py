"""Compare a query with its SQL on the same parquet tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

from turnloom.plans.oracles import ORACLES
from turnloom.plans.queries import QUERIES


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    """None for what is missing, whole numbers without a fraction; frames differ in both."""
    if pd.isna(value):
        return None
    value = value.item() if hasattr(value, "item") else value
    return int(value) if isinstance(value, float) and value.is_integer() else value


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows sorted, every missing value None."""
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(plain(value) for value in row)
        for row in frame.itertuples(index=False, name=None)
    ]
    return pd.DataFrame(sorted(rows, key=repr), columns=frame.columns, dtype=object)


def differences(spark, con, sf: str, name: str) -> str | None:
    """None where both agree, else what differs first."""
    result = QUERIES[name](spark, sf)
    expected = con.execute(ORACLES[name])
    names = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    wanted = {column[0]: str(column[1]) for column in expected.description}
    types = {c: names.get(t, t) for c, t in result.dtypes}
    if types != wanted:
        return f"types {types} and {wanted}"
    ours, theirs = canonical(result.toPandas()), canonical(expected.df())
    if list(ours.columns) != list(theirs.columns):
        return f"columns {list(ours.columns)} and {list(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    for a, b in zip(ours.itertuples(index=False), theirs.itertuples(index=False)):
        if tuple(a) != tuple(b):
            return f"{tuple(a)!r:.600} and {tuple(b)!r:.600}"
    return None
