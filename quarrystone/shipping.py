"""The package on its way to the executors of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Give every Python worker of this session the package as it stands here; where a wheel is installed it is not needed.

    Call it once after the session has started. The archive is handed out by the driver, so no folder has to be shared.
    """
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarrystone-ship-"), "quarrystone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
    return path
