"""Compares queries with their SQL in DuckDB, whatever the order of rows and columns."""

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf: str = SF):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    cell = lambda x: "null" if x is None or x is pd.NaT or isinstance(x, float) and pd.isna(x) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted("|".join(cell(x) for x in r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def compare(spark, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), connection(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = _rows(got), _rows(want)
    assert len(a) == len(b)
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    assert not differing, differing[:3]
