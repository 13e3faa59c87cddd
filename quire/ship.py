"""Gives the package to Python workers that can't import it: once an application, through Spark's file server."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    import quire

    context = spark.sparkContext
    folder = os.path.dirname(os.path.abspath(quire.__file__))
    if context.applicationId in _done or not os.path.isdir(folder):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.join("quire", os.path.relpath(full, folder)))
    context.addPyFile(path)
    _done.add(context.applicationId)
    return spark
