"""Sends this package to the Python workers, where it may not be installed."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the files of the application, once."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="epsgroup-"), "epsgroup.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    source = os.path.join(folder, name)
                    archive.write(source, os.path.relpath(source, os.path.dirname(home)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
