"""Reading the given tables, and tables written once to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from methylspark.shared import shared_folder

#: Columns of ``documents``, in order.
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]

#: White space between words; everything else belongs to a word.
BLANK = r"[ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Written:
    """Tables written to the shared folder and read back; ``drop`` removes one."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self._count = 0
        self._paths: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self._root}/{self._count}"
        df.write.parquet(path)
        back = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete what :meth:`__call__` has written for ``df``."""
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self._spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(
                target, True)


#: Rows up to which a table of one or two 64-bit keys is broadcast: about 16 MB.
SMALL = 1_000_000


def maybe_small(df: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= SMALL else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.coalesce(F.array_remove(F.split(text, BLANK), ""), F.array().cast("array<string>"))
