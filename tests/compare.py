"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v) -> str:
    if v is None or (not isinstance(v, (list, tuple, str)) and pd.isna(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.10g}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    whole = {
        c: df[c].astype("object").map(
            lambda v: int(v) if isinstance(v, float) and v == v and v == int(v) else v
        )
        for c in df.columns
    }
    return sorted(tuple(_cell(v) for v in r) for r in zip(*whole.values()))


def differences(spark_df, oracle: pd.DataFrame) -> list[str]:
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(oracle.columns):
        return [f"columns {sorted(got.columns)} != {sorted(oracle.columns)}"]
    a, b = rows(got), rows(oracle)
    if a == b:
        return []
    only_a, only_b = set(a) - set(b), set(b) - set(a)
    out = [f"rows {len(a)} != {len(b)}" if len(a) != len(b) else "values differ"]
    out += [f"  spark only: {r}" for r in sorted(only_a)[:3]]
    out += [f"  oracle only: {r}" for r in sorted(only_b)[:3]]
    return out
