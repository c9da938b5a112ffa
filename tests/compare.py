"""Order-insensitive comparison of two results by column name."""

import math


def _value(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return int(v) if isinstance(v, bool) else v


def rows(pdf):
    columns = sorted(pdf.columns)
    out = [tuple(_value(x) for x in r) for r in pdf[columns].astype(object).itertuples(index=False, name=None)]
    return columns, sorted(out, key=lambda t: tuple("" if x is None else str(x) for x in t))
