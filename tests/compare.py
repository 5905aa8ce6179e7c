"""Rows of two results as sorted text, so that results compare whatever their order and number types."""

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "∅"
    if type(v).__name__ in ("NaTType", "NAType"):
        return "∅"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False, name=None))
