"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(name: str = "sievelark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and skew-join handling; ANSI mode stays on.

    With ``master`` unset the cluster's own settings decide where it runs. A local master
    is bound to loopback so that results can be fetched in a container without network.
    """
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (
                builder.config("spark.driver.host", "127.0.0.1")
                .config("spark.driver.bindAddress", "127.0.0.1")
                .config("spark.ui.enabled", "false")
            )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application.

    Functions that run there are pickled by reference to their module. Spark serves the archive from the driver, so it needs
    no shared folder; where the package is installed on all machines this changes nothing.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    if package.is_dir():  # else it is imported from an archive that was shipped already
        archive = Path(tempfile.mkdtemp(prefix="sievelark-")) / "sievelark.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)
