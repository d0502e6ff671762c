"""Rows of a registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import numpy as np


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if x is None or (isinstance(x, float) and np.isnan(x)) or str(x) in ("NaT", "<NA>") else round(float(x), 6) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (np.integer, np.bool_, bool)) else str(x) for x in r))
    return sorted(frame.columns), sorted(out, key=str)


def duck(sf_dir, sql):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c.execute(sql).df()
