"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "voxelmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; conf keys use ``__`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only on one machine (a local master) a temporary folder is made and remembered where the setting is missing; on a cluster RuntimeError.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="voxelmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxelmill/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    Unlike executor-local storage the copy outlives any executor, and later reads prune columns. ``row_group`` bounds the bytes of a row
    group where rows are large (its size is then looked at after every row).
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": row_group, "parquet.page.size.row.check.min": 1} if row_group else {}
    df.write.mode("error").options(**sizes).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """``(path, file system)`` as Hadoop objects."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_written(spark: SparkSession) -> None:
    """Delete what :func:`written` has put into the shared folder in this application; no table made from it can be read afterwards."""
    path, files = hadoop_path(spark, _own_dir(spark))
    files.delete(path, True)
