"""Texts kept under an id in the shared folder, to be read again as files."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

EXPIRY_HOURS = 24


def folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named}/uploads"


def upload_path(spark: SparkSession, upload_id: str, suffix: str = "") -> str:
    """The path of an upload; fails if the id isn't 32 hex digits or nothing is kept under it."""
    path = _path(spark, upload_id, suffix)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(upload_id)
    return path


def _path(spark: SparkSession, upload_id: str, suffix: str) -> str:
    if not re.fullmatch("[0-9a-f]{32}", upload_id):
        raise ValueError("an upload's id is 32 hex digits")
    return f"{folder(spark)}/{upload_id}{suffix}"


def new_path(spark: SparkSession) -> str:
    """A path for a new upload. Uploads that are older than EXPIRY_HOURS are deleted first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(root):
        for kept in files.listStatus(root):
            if kept.getModificationTime() < (time.time() - EXPIRY_HOURS * 3600) * 1000:
                files.delete(kept.getPath(), True)
    return _path(spark, uuid.uuid4().hex, "")


def store(lines: DataFrame, suffix: str = "") -> str:
    """Write (value) as text files, one for each partition; the id they are kept under for EXPIRY_HOURS at least."""
    path = new_path(lines.sparkSession)
    lines.write.text(path + suffix)
    return path.rsplit("/", 1)[1]
