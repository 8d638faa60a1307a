"""Sends this package to the executors, for clusters where it is not installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's files (some 100 kB) to the session's Python path, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="loomgraph-code-"), "loomgraph.zip")  # on the driver; Spark serves it
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for n in names:
                if n.endswith((".py", ".peg")):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(target)
    _sent.add(sc.applicationId)
