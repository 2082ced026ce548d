"""Token counts kept up to date by signed deltas, with idempotent batch commits.

A rollup is a folder of committed batches. A batch is a table of changes of documents: inserts
count +1 document and +n tokens, deletes -1 and -n, revisions 0 and the difference of the counts; a
change of source, language or tokenizer version is a delete and an insert. Changes are summed by
(source, lang, tokenizer) before they are written, so a batch costs as many rows as it has groups.
A batch is written aside and renamed to its own name in one step: a batch that is already there is
left alone, so commits can be repeated after any failure. Totals are the sum of all batches.

Null source, language and version are groups of their own; a null count is 0. Groups without
documents and tokens left are not returned. Repeated rows of a batch count each. Empty batches are
committed as such; a rollup without batches is empty. Other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas of ``changes(op, source, lang, tokenizer, n_tokens, old_tokens)``.

    ``op``: insert, delete or revise. ``old_tokens`` is read for revisions only.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    return changes.filter(F.col("op").isin("insert", "delete", "revise")).groupBy(*KEYS).agg(
        F.sum(sign).cast("long").alias("n_docs"),
        F.sum(F.when(F.col("op") == "revise", n - old).otherwise(sign * n)).cast("long")
        .alias("n_tokens"))


class Rollup:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark = spark
        self._folder = folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._files = self._path(self._folder).getFileSystem(conf)

    def _batch(self, name: str) -> str:
        if not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("batch names are letters, digits, - and _")
        return f"{self._folder}/batches/batch={name}"

    def committed(self, name: str) -> bool:
        return self._files.exists(self._path(self._batch(name)))

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Add a batch; False, and no work, if it is there already."""
        if self.committed(name):
            return False
        aside = f"{self._folder}/aside/{uuid.uuid4().hex}"
        signed(changes).write.parquet(aside)
        self._files.mkdirs(self._path(f"{self._folder}/batches"))
        # a rename onto a folder would move into it, so look again at the last moment
        done = not self.committed(name) and self._files.rename(
            self._path(aside), self._path(self._batch(name)))
        self._files.delete(self._path(aside), True)
        return bool(done)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)`` over all committed batches."""
        place = f"{self._folder}/batches"
        if not self._files.exists(self._path(place)):
            return self._spark.createDataFrame([], SCHEMA)
        deltas = self._spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(
            place)
        return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"),
                                         F.sum("n_tokens").alias("n_tokens")).filter(
            "n_docs <> 0 or n_tokens <> 0")
