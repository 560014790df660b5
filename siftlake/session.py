"""Sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import site
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, unless the session has a setting of its own: rows can be long texts, and both sides hold whole batches.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def local_session(app: str = "siftlake", cpus: int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", os.environ.get("SIFTLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes Arrow batches small and sends this package to the workers, once a session, unless they find it themselves: installed, or in local mode on
    PYTHONPATH or in the working folder."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    local = context.master.startswith("local") and package.parent in [*known, Path.cwd()]
    if local or str(package.parent) in [*site.getsitepackages(), site.getusersitepackages()]:
        return
    folder = tempfile.mkdtemp(prefix="siftlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "siftlake.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))


def shipped(f):
    """A function of a session and more, before which the workers get this package."""

    @functools.wraps(f)
    def run(spark: SparkSession, *rest):
        ship(spark)
        return f(spark, *rest)

    return run
