import pytest

from epsgroup.workspace import Workspace

#: Names that operators use inside, as columns a user's table may have.
CLASHING = ("doc", "id", "key", "node", "text_", "length", "chunk", "part", "n", "bytes", "size", "shard", "region", "line", "kind", "value")


@pytest.fixture
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path))


@pytest.fixture
def frame(spark):
    """A table with extra columns of clashing names."""

    def make(rows, schema):
        names = {part.split()[0] for part in schema.split(", ")}
        extra = [c for c in CLASHING if c not in names]
        full = ", ".join([schema, *(f"{c} string" for c in extra)])
        return spark.createDataFrame([(*r, *("x" for _ in extra)) for r in rows], full)

    return make
