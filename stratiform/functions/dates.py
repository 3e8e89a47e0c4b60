from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_parts(column: Column | str, prefix: str = "") -> dict[str, Column]:
    """Year, month and day-of-month columns, named for ``DataFrame.withColumns``."""
    return {
        f"{prefix}year": F.year(column),
        f"{prefix}month": F.month(column),
        f"{prefix}day": F.dayofmonth(column),
    }
