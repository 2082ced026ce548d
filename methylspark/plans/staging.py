"""Tables written once to the shared folder and read back.

A long analysis is cut at the tables that several later steps read. Writing them
bounds recomputation when executors are lost, and lets Parquet statistics prune
by position.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from methylspark.shared import shared_folder


class Store:
    """Tables below a folder of their own in the shared folder, until ``drop``.

    A table is found again by its name and by what it was computed from: another analysis on the
    same store, with other inputs or parameters, writes tables of its own.
    """

    def __init__(self, spark: SparkSession, scope: str) -> None:
        self._spark = spark
        self._root = f"{shared_folder(spark)}/methylspark/{scope}-{uuid.uuid4().hex[:12]}"
        self._done: dict[str, list[DataFrame]] = {}

    def path(self, name: str) -> str:
        """A place of that name in this store's folder, for writers of other formats."""
        return f"{self._root}/{name}"

    def _path(self, name: str, number: int) -> str:
        return self.path(f"{name}-{number}")

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        known = self._done.setdefault(name, [])
        number = next((k for k, old in enumerate(known) if old.sameSemantics(df)), len(known))
        if number == len(known):
            df.write.option("compression", "zstd").parquet(self._path(name, number))
            known.append(df)
        return self._spark.read.schema(df.schema).parquet(self._path(name, number))

    def drop(self) -> None:
        """Delete all tables of this store; tables read from it can no longer be used."""
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._root)
        path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(
            path, True)
        self._done.clear()


def keep_lazy(name: str, df: DataFrame) -> DataFrame:
    """A store that writes nothing: the whole analysis stays one plan."""
    return df
