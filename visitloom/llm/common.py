"""What several operators of this subpackage share: shared-folder tables and text folding."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.session import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Java regular expression of the white space that separates words in size and shingle rules.
SPACES = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables written in the shared folder to cut lineage; they survive lost executors.

    ``save`` writes a DataFrame as Parquet and returns a fresh reader of it. ``drop`` deletes
    a table that nothing will read again. What an operator returns may still read its last
    tables, so these stay until ``close``, which the caller of an operator can call on a
    scratch of its own, or until the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Delete all that is left; nothing made from this scratch can be read afterwards."""
        atexit.unregister(self._at_exit)
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _at_exit(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session and its JVM may be gone already
            pass


#: A side of a join is broadcast below this many estimated bytes.
BROADCAST_BYTES = 16 << 20


def small_side(saved: DataFrame, width: int) -> DataFrame:
    """A saved table as the side of a join that is asked, its rows taking about ``width`` bytes.

    It is broadcast if its counted rows stay within BROADCAST_BYTES. Beyond that the join is a
    shuffled hash join built on this side, so that texts on the other side need no sort.
    """
    rows = BROADCAST_BYTES // width
    return F.broadcast(saved) if saved.limit(rows + 1).count() <= rows else saved.hint("shuffle_hash")


def fold_az(col: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does that on pure ASCII, much faster than ``translate``; other texts take
    ``translate`` because ``lower`` would also fold letters beyond ASCII.
    """
    ascii_only = F.octet_length(col) == F.char_length(col)
    return F.when(ascii_only, F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def split_words(col: Column, separators: str) -> Column:
    """Words between runs of separators; null gives null."""
    return F.array_remove(F.split(col, separators), "")


def word_count(col: Column) -> Column:
    """Number of words between white space; null counts none."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.size(split_words(col, SPACES))).cast("long")


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without the input columns whose names the operator itself adds: its own columns win."""
    added = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in added])


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The input with clashing columns renamed, and the columns that restore it afterwards."""
    added = {n.lower() for n in names}
    renamed = {c: f"_aside_{c}" for c in df.columns if c.lower() in added}
    return df.withColumnsRenamed(renamed), [F.col(renamed.get(c, c)).alias(c) for c in df.columns]
