"""Compare a query's rows with those of its SQL, order aside."""

import numbers

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return ""
    if isinstance(v, numbers.Real) and not isinstance(v, bool) and abs(v) < 1 << 53:
        # Columns of integers with gaps come as floats from one side.
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(frame, cols):
    return sorted(tuple(cell(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False))


def check(spark, sf_dir, f, sql):
    got = f(spark, sf_dir).toPandas()
    with duckdb.connect() as c:
        for t in TABLES:
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = c.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)
