"""Size checks in front of broadcasts and driver-held points."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
POINT_BYTES = 64 << 20


def join_small(rows: DataFrame, small: DataFrame, on, small_rows: int, how: str = "inner") -> DataFrame:
    """Join with a side of counted size: broadcast up to BROADCAST_ROWS narrow rows, a shuffle join beyond."""
    return rows.join(F.broadcast(small) if small_rows <= BROADCAST_ROWS else small, on, how)


def points_fit(points: int, dimension: int) -> bool:
    """Whether that many vectors may be held by the driver and every task."""
    return points * dimension * 8 <= POINT_BYTES


def dimension_of(df: DataFrame, column: str = "features") -> int:
    """Number of coordinates of the first row, 0 for an empty table."""
    row = df.select(F.size(column)).head()
    return row[0] if row else 0
