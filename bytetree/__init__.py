"""Queries over structured binary data on Spark. See `session.Session`."""

from __future__ import annotations


def ship(spark) -> str:
    """Send this package to the executors of a cluster that doesn't have it installed, as `spark-submit --py-files` would; the
    path of the archive that was sent. Functions that run on executors are pickled by name, so workers must find the package."""
    import shutil
    import tempfile
    from pathlib import Path

    here = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", here.parent, here.name)  # the driver's own copy
    spark.sparkContext.addPyFile(archive)
    return archive
