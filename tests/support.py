"""What the tests share: the smallest tables, and rows in a form that can be compared."""

import pandas

DATA = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, dict)):
        return value
    if value is None or pandas.isna(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    return value


def rows(frame):
    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=repr)
