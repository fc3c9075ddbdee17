"""Session construction with the settings the operators assume."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "strainspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS and then ``conf`` (dots written as ``__``) applied."""
    builder = SparkSession.builder.appName(app).config(map=DEFAULTS)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_strainspark_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # served by the driver as long as the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/strainspark.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, f"{here.name}/{path.relative_to(here)}")
    context.addPyFile(archive)
    context._strainspark_shipped = True
