"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import Files

_made: list = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in a local session (tests) and a folder of the
    warehouse in any other."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        local = master.startswith("local") and not master.startswith("local-cluster")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def keep_written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder, which ends its lineage; it goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid4().hex}"
    _made.append((spark, path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_lake(spark: SparkSession):
    """A new lake in the shared folder, its metadata in a file of the driver; both go when the program ends."""
    from tidemark.lake import Lake

    root = f"{shared_folder(spark)}/lake-{uuid4().hex}"
    own = tempfile.TemporaryDirectory(prefix="tidemark-")
    lake = Lake(spark, root, metadata=Path(own.name) / "metadata.sqlite")
    _made.append((spark, lake.path, own))
    return lake


@atexit.register
def _clean() -> None:
    for spark, path, _ in _made:
        try:
            Files(spark).delete(path)
        except Exception:  # noqa: BLE001  the session has already gone; nothing is left to do
            return
