"""Result tables as numbered snapshots.

A full refresh writes a new numbered folder and never touches the one readers
use; a folder counts once its ``_SUCCESS`` marker is there, so a lost job leaves
the previous snapshot in force and no file is ever renamed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotTable:
    """One result table below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(
            self.spark.sparkContext._jsc.hadoopConfiguration()
        )

    def versions(self) -> list[int]:
        """Numbers of the finished snapshots, oldest first."""
        path, files = self._files()
        found = files.globStatus(path(f"{self.path}/v=*/_SUCCESS")) or []
        return sorted(int(s.getPath().getParent().getName().removeprefix("v=")) for s in found)

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self) -> DataFrame:
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no finished snapshot below {self.path}")
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}")

    def refresh(self, df: DataFrame, keep: int = 2) -> DataFrame:
        """Replace the content, also by an empty table; older snapshots than ``keep`` go."""
        path, files = self._files()
        versions = self.versions()
        number = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(f"{self.path}/v={number}")
        for old in (versions + [number])[:-keep]:
            files.delete(path(f"{self.path}/v={old}"), True)
        return self.read()

    def append(self, df: DataFrame) -> None:
        """Add rows to the current snapshot."""
        versions = self.versions()
        number = versions[-1] if versions else 1
        df.write.mode("append").parquet(f"{self.path}/v={number}")


def keyed_replace(
    existing: DataFrame, new: DataFrame, touched: DataFrame, keys: list[str]
) -> DataFrame:
    """Replace all rows of the touched keys by ``new``.

    ``touched`` lists the keys asked for, so a key whose new list is empty still
    loses its old rows.
    """
    return existing.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def served_lists(lists: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to store, and the keys ``user_id, rec_type`` whose old rows they replace.

    A requested user without a list has asked for best sellers, whose old rows go.
    """
    served = lists.select("user_id", "rec_type").distinct()
    touched = (
        requested.select("user_id")
        .join(served, "user_id", "left")
        .withColumn("rec_type", F.coalesce("rec_type", F.lit("trending")))
    )
    return lists.select("user_id", "product_id", "score", "rec_type"), touched


def recommendations_upsert(existing: DataFrame, lists: DataFrame, requested: DataFrame) -> DataFrame:
    """The stored lists with each requested user's rows of the type just served replaced."""
    new, touched = served_lists(lists, requested)
    return keyed_replace(existing, new, touched, ["user_id", "rec_type"])
