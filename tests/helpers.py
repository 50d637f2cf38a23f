"""What the tests share."""

from datetime import datetime, timedelta

NOW = datetime(2024, 3, 1, 12, 0)


def ago(hours: float) -> datetime:
    return NOW - timedelta(hours=hours)


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
