"""A query language over media metadata, and operators that prepare it as training data, on Spark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Sends this package to all executors of a session, where it is not installed on them.

    The operators run parts of the package in Python workers, which must be able to import it: by a wheel that is
    installed there, by PYTHONPATH, or by this. The driver serves the archive to executors, also to later ones, until
    its process ends.
    """
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="siltline-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/siltline.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(p for p in package.rglob("*") if p.suffix in (".py", ".json")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/siltline.zip")
