"""Compares a query's rows with those of its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows(frame, columns):
    frame = frame[columns].copy()
    for c in columns:  # whole numbers with nulls among them are floats in pandas, or not
        if str(frame[c].dtype) == "float64" and frame[c].isna().any() and (frame[c].dropna() % 1 == 0).all():
            frame[c] = frame[c].astype("Int64")
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).to_numpy().tolist()))


def check(db, got, sql):
    want = db.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
