"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "folio", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    Cluster settings win: only values that are not yet set are filled in.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_folio_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parent
    archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "folio.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._folio_shipped = True


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for stage tables: the checkpoint folder of the cluster.

    Only in local mode, as in tests, an unset `spark.checkpoint.dir` gives way to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a stage table to the shared folder and read it back.

    Several consumers then share one evaluation, a lost executor costs no recomputation, and readers keep column
    pruning, filter pushdown and sizes.
    """
    path = f"{stage_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def drop_stage(*tables: DataFrame) -> None:
    """Delete stage tables that nothing reads any more; other tables are left alone."""
    for table in tables:
        if path := getattr(table, "_stage_path", None):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
