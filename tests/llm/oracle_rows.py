"""Rows of a data frame in a form that two engines share."""

import math

import pandas as pd


def rows(frame):
    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(one, r)) for r in frame.astype(object).itertuples(index=False, name=None))
