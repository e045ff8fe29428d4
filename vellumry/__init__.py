"""Vellumry: a Spark-native engine that turns files into queryable document tables and back."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package to the executors, once per application, so that their Python workers can
    import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # it runs from a package that was sent already
        return
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="vellumry-")), "vellumry.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
