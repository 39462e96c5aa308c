"""Compare a query with its SQL, run by DuckDB on the same files."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(d: pd.DataFrame) -> pd.DataFrame:
    d = d[sorted(d.columns)].copy()
    for c in d:
        x = d[c]
        if str(x.dtype).startswith("datetime"):
            d[c] = x.astype("datetime64[us]").astype(str)
        elif x.dtype == object or str(x.dtype).startswith("str"):
            d[c] = ["" if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v) for v in x]
        else:
            d[c] = x.astype(float)
    return d.sort_values(list(d.columns)).reset_index(drop=True)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    assert len(a) == len(b)
    a, b = canonical(a), canonical(b)
    for c in a:
        if a[c].dtype == float and b[c].dtype == float:
            np.testing.assert_allclose(a[c], b[c], rtol=1e-7, atol=1.01e-6, err_msg=c)
        else:
            assert list(a[c].astype(str)) == list(b[c].astype(str)), c
