"""Rows of a Spark and a DuckDB result in one comparable form."""

import pandas as pd


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "∅"
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind == "b":
        return str(int(v))
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.astype(object).itertuples(index=False))
