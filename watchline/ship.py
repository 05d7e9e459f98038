"""Make the package importable in Python workers, wherever the driver imported it from."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as --py-files would."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):
        # The archive is only read by this driver, which serves it to the executors.
        archive = os.path.join(tempfile.mkdtemp(prefix="watchline-"), "watchline.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(archive)
    _done.add(sc.applicationId)
