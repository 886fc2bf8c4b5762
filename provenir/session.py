"""One place for the session settings that the library's results depend on."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

FILE_BYTES, MEMORY_BYTES = 1 << 20, 10 << 20  # of a table that all tasks may get unasked: as its files have them, and as they are in memory
_STATIC, _ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def get_spark(app: str = "provenir", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive plans and last-wins map keys.

    Pass further settings as keyword arguments with dots written as two underscores.
    """
    b = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        b = b.master(master or os.environ["SPARK_MASTER"])
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        _STATIC: str(FILE_BYTES),
        _ADAPTIVE: str(MEMORY_BYTES),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def _bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)[a-z]*", setting.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def bound_broadcasts(spark: SparkSession) -> None:
    """Before it runs, a join knows a written table by the size of its files, which for ids are far smaller than the rows in memory, and such a table would go through the driver to all tasks. So a file size of FILE_BYTES is
    the most at which a plan begins with that; sizes that running stages have measured are those in memory, and up to MEMORY_BYTES of these still go to all tasks. Lower settings stay.
    """
    if _bytes(spark.conf.get(_STATIC)) > FILE_BYTES:
        if spark.conf.get(_ADAPTIVE, None) is None:
            spark.conf.set(_ADAPTIVE, str(MEMORY_BYTES))
        spark.conf.set(_STATIC, str(FILE_BYTES))


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they couldn't: where it is neither on PYTHONPATH nor in the working folder. Broadcasts are bounded."""
    bound_broadcasts(spark)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    reachable = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    context = spark.sparkContext
    if os.path.realpath(root) in reachable or getattr(context, "_provenir_shipped", False):
        return spark
    folder = tempfile.mkdtemp(prefix="provenir-")  # tasks fetch the file from here while the session lasts
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "provenir.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(os.path.join(root, "provenir")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(base, n), os.path.relpath(os.path.join(base, n), root))
        if os.path.exists(pipeline := os.path.join(root, "corpus_pipeline.py")):
            z.write(pipeline, "corpus_pipeline.py")
    context.addPyFile(path)
    context._provenir_shipped = True
    return spark
