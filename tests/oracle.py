"""Compares a query with its SQL on one folder of driver tables."""

import os
import tempfile

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


def connect(folder: str = SF):
    con = duckdb.connect(config={"temp_directory": os.path.join(tempfile.gettempdir(), "voxmill-duckdb")})  # not the working folder
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{folder}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{folder}/{t}.parquet') else ''}'")
    return con


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    if hasattr(v, "isoformat"):
        return str(v)
    return round(float(v), 5) if isinstance(v, int | float) or hasattr(v, "dtype") else v


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(_value, r))) for r in frame.itertuples(index=False, name=None))


def same(spark_frame, con, sql: str) -> None:
    relation = con.sql(sql)
    assert sorted(spark_frame.columns) == sorted(relation.columns)
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: KINDS.get(k, k) for c, k in spark_frame.dtypes} == types
    assert rows(spark_frame.toPandas()) == rows(relation.df())
