"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "gradeloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the engine's defaults; conf may override them."""
    ship_path()
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=settings).getOrCreate()


def ship_path() -> None:
    """Lets local Python workers import this package: for sessions that start after this."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT.parent), *filter(None, paths)])


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors of a running session, once."""
    context = spark.sparkContext
    if not getattr(context, "_gradeloom_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix="gradeloom-")) / "gradeloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
        context.addPyFile(str(archive))
        context._gradeloom_shipped = True
    return spark


_FOLDERS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    A folder of our own only where neither is set and all runs in one process; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _remove_at_exit(files, path) -> None:
    with contextlib.suppress(Exception):  # the gateway may be gone by then
        files.delete(path, True)


def app_folder(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it goes when the driver's process ends."""
    folder = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        # both outlive the session
        atexit.register(_remove_at_exit, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)
    return folder


def written(df: DataFrame, release: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once.

    release: its shuffle files go when it is written, not only when the driver collects its garbage.
    """
    spark, option = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{app_folder(spark)}/{uuid.uuid4().hex}", spark.conf.get(option, "false")
    spark.conf.set(option, "true" if release else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(option, before)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str):
    """df as a table in the shared folder, in one bucket a shuffle partition by key: for loops that group by it again and again."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    parts, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{app_folder(spark)}/{name}"
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """df read back from a reliable checkpoint in the shared folder; for small tables, and where plans must not grow."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
