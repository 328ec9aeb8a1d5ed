"""Vector functions as Spark columns. A vector is an ARRAY<DOUBLE>."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(a: Column, length: int | Column) -> Column:
    """The vector; one of another length fails the job."""
    wrong = F.raise_error(F.format_string("a vector has %s coordinates", F.size(a))).cast("array<double>")
    return F.when(a.isNull() | (F.size(a) == length), a).otherwise(wrong)


def distance_sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed from the first coordinate to the last. Vectors of unequal length fail."""
    parts = F.zip_with(checked(a, F.size(b)), b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(parts, F.lit(0.0), lambda total, part: total + part)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(distance_sq(a, b))


def add(a: Column, b: Column) -> Column:
    """Coordinate by coordinate. Vectors of unequal length fail."""
    return F.zip_with(checked(a, F.size(b)), b, lambda x, y: x + y)


def scale_down(a: Column, n: Column) -> Column:
    """Every coordinate divided by n."""
    return F.transform(a, lambda x: x / n)


def to_text(a: Column) -> Column:
    return F.concat_ws(",", F.transform(a, lambda x: x.cast("string")))


def order_key(a: Column) -> Column:
    """Vectors sort coordinate by coordinate, which is how Spark compares arrays."""
    return a.asc()


def vector(*columns: str | Column) -> Column:
    """A vector column from scalar columns."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.array(*[c.cast("double") for c in cols])


def let(value: Column, body) -> Column:
    """body(value), with the value computed once per row wherever the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
