"""Shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import structura


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Python functions inside tasks import their module; the package need not
    be installed on the workers for that.
    """
    sc = spark.sparkContext
    if getattr(sc, "_structura_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(structura.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="structura-zip-"), "structura_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("structura", os.path.relpath(full, root)))
    sc.addPyFile(target)
    sc._structura_shipped = True
