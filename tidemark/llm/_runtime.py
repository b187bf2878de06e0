"""Shared plumbing: where intermediate tables go, and how they are written and read again."""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) takes a temporary folder and any other session a folder
    in its warehouse, which executors share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm_shared"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that is removed when the program ends, or sooner by ``release``."""
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, so a lost
    executor costs a re-read, never a recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_folder = path
    return out


def forget(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written() -> int:
    """How many folders there have been; an argument for ``release``."""
    return len(_written)


def release(since: int, *keep: DataFrame) -> None:
    """Remove the folders written since then, but those of ``keep``: nothing that reads them is used any more."""
    kept = {getattr(df, "_llm_folder", None) for df in keep}
    for k in range(since, len(_written)):
        spark, path = _written[k]
        if path is not None and path not in kept:
            forget(spark, path)
            _written[k] = (spark, None)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        if path is None:
            continue
        try:
            forget(spark, path)
        except Exception:  # noqa: BLE001  the session has already gone; nothing is left to do
            return


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
