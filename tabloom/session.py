"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = Path(__file__).resolve().parent.parent
_SHIPPED: dict[str, bool] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for an application, unless PYTHONPATH does."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(HOME) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp(prefix="tabloom-package-")) / "tabloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((HOME / "tabloom").rglob("*.py")):
            z.write(p, p.relative_to(HOME))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED[app] = True


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, with the settings the tests and the benchmark use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tabloom")
    for k, v in {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); on one machine, in a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or tempfile.mkdtemp(prefix='tabloom-')).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written once, to be read several times, and where it is; columns go by their places, so that names may be any."""
    path = scratch(df.sparkSession, label)
    df.toDF(*[f"c{i}" for i in range(len(df.columns))]).write.parquet(path)
    return df.sparkSession.read.parquet(path).toDF(*df.columns), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete what stored() wrote, once nothing will read it again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
