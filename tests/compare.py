"""Order-insensitive comparison of a Spark result with an oracle result:
row count, column names and an MD5 over canonical row text."""

from __future__ import annotations

import hashlib
import math

import pandas as pd


def canon(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    return str(v)


def digest(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(canon(r[c]) for c in cols) for r in pdf.to_dict("records"))
    return len(rows), cols, hashlib.md5("\n".join(rows).encode()).hexdigest()
