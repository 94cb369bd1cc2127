"""Folders for intermediate tables, on storage every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_FOLDER_SETTING = "spark.checkpoint.dir"

#: Stands in for the setting above in local sessions that were started without it.
LOCAL_FOLDER_SETTING = "tablepact.local.dir"


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the shared folder the cluster names."""
    shared = spark.conf.get(SHARED_FOLDER_SETTING, None) or spark.conf.get(LOCAL_FOLDER_SETTING, None)
    if not shared:
        raise ValueError(f"set {SHARED_FOLDER_SETTING} to a folder shared by all executors")
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table under the shared folder: what is read from it more than once is worked out once."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def use_local_folder(spark: SparkSession, folder: str) -> None:
    """Name a folder of this machine for intermediate tables, where a local session names none."""
    named = spark.conf.get(SHARED_FOLDER_SETTING, None) or spark.conf.get(LOCAL_FOLDER_SETTING, None)
    if not named and spark.conf.get("spark.master", "").startswith("local["):
        spark.conf.set(LOCAL_FOLDER_SETTING, f"{folder.rstrip('/')}/tablepact-{uuid.uuid4().hex}")
