"""Order-insensitive comparison of two pandas frames."""

from __future__ import annotations

import pandas as pd

DATA = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else float(f"{v:.9g}"))
        df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: "NULL" if v is None else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    a, b = normal(left), normal(right)
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    for c in a.columns:
        different = a[c] != b[c]
        assert not different.any(), (c, a[c][different].head(3).tolist(), b[c][different].head(3).tolist())
