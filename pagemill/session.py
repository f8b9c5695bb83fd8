"""Sessions, table loading and stage materialisation shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "pagemill") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs in this process (tests) a temporary folder is made and entered there; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="pagemill-")
        atexit.register(shutil.rmtree, where, True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    The files survive the loss of any executor, and a reader of few columns reads only those.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/pagemill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete what ``written`` has made in this application; nothing that came from it can be read any more."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(where) if "://" in (where := shared_dir(spark)) else (fs.LocalFileSystem(), where.removeprefix("file:"))
    path = f"{path.rstrip('/')}/pagemill-{spark.sparkContext.applicationId}"
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)
