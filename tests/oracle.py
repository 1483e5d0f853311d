"""Compare a query with its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def compare(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    expected = Counter(tuple(_plain(v) for v in r) for r in want.fetchall())
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    found = Counter(tuple(_plain(v) for v in r) for r in df.select(*names).collect())
    assert found == expected
