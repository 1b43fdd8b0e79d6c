"""The package for executors whose Python can't import it from where they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkContext


def ship() -> None:
    """Send this package to the active context's Python workers, once a context."""
    context = SparkContext._active_spark_context
    if context is None or getattr(context, "_loom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="loom-"), "threadloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._loom_shipped = True
