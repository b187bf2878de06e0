"""Folders of a lake on any file system that Hadoop can open: a shared mount, HDFS or an object store."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


class Files:
    """Driver-side file operations; data itself is read and written by Spark."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    @staticmethod
    def root(path: str | Path) -> str:
        """A path without a scheme is a folder of this machine or of a mount that all machines share."""
        text = str(path).rstrip("/")
        return text if "://" in text or text.startswith("file:") else "file://" + os.path.abspath(text)

    @staticmethod
    def local(path: str) -> Path | None:
        """The local path of a file: URI; None for any other file system."""
        return Path("/" + path.removeprefix("file:").lstrip("/")) if path.startswith("file:") else None

    def _open(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._open(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str]:
        """Names in a folder, from one listing; none where there is no folder."""
        fs, at = self._open(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def commits(self, root: str) -> dict[str, set[str]]:
        """Names of the commit folders of every dataset folder below raw and items, from one listing."""
        out: dict[str, set[str]] = {}
        local = self.local(root)
        if local is not None:
            found = [str(p.relative_to(local)) for pattern in ("raw/*/*/commit=*", "items/*/commit=*") for p in local.glob(pattern)]
        else:
            fs, _ = self._open(root)
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            found = [s.getPath().toString().removeprefix(root).lstrip("/") for pattern in ("raw/*/*/commit=*", "items/*/commit=*") for s in (fs.globStatus(path(f"{root}/{pattern}")) or ())]
        for f in found:
            folder, name = f.rsplit("/", 1)
            out.setdefault(folder, set()).add(name)
        return out

    def make(self, path: str) -> None:
        fs, at = self._open(path)
        fs.mkdirs(at)

    def delete(self, path: str) -> None:
        fs, at = self._open(path)
        fs.delete(at, True)

    def copy(self, source: str, target: str) -> None:
        (a, at), (b, to) = self._open(source), self._open(target)
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, at, b, to, False, True, self.spark.sparkContext._jsc.hadoopConfiguration())

    def usage(self, path: str) -> dict:
        fs, at = self._open(path)
        if not fs.exists(at):
            return {"files": 0, "bytes": 0}
        found = fs.getContentSummary(at)
        return {"files": found.getFileCount(), "bytes": found.getLength()}
