"""Folder listings: logs in order, screenshots by their stamp, settings out of text files, snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.sources import combat_logs

#: Bytes at a file's end in which its last stamped line is looked for, a fixed value.
TAIL_BYTES = 64 * 1024


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(name, path, modified_at, bytes) of files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.unix_seconds("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def logs(files: DataFrame, prefix: str = "combatlog") -> DataFrame:
    """Logs by case-folded prefix, oldest first, those of unknown date before all."""
    return files.where(F.lower("name").startswith(prefix)).orderBy(F.col("modified_at").asc_nulls_first(), "name")


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last bytes of each file; files that can't be opened have none."""
    from pyarrow import fs

    for files in batches:
        out = []
        for path in files["path"]:
            try:
                store, at = fs.FileSystem.from_uri(quote(path, safe=":/"))
                with store.open_input_file(at) as f:
                    size = f.size()
                    f.seek(max(0, size - TAIL_BYTES))
                    out.append(f.read().decode("utf-8", "replace"))
            except (OSError, ValueError):
                out.append(None)
        yield pd.DataFrame({"path": files["path"], "tail": out})


def tail_stamps(files: DataFrame, year: int, offset: int = 0) -> DataFrame:
    """(path, at_ms) of the last stamped line of each file, out of its last 64 KiB alone.

    That line may be half written: its stamp stands at its front. Stamps without a year get ``year``.
    Files without a stamped line, and those that can't be opened, have none and are left out.
    """
    tails = files.select("path").mapInPandas(_tails, "path string, tail string").where("tail IS NOT NULL")
    lines = tails.select(F.col("path").alias("log"), F.posexplode(F.split("tail", r"\r?\n")).alias("line_no", "line"))
    stamped = combat_logs.parse(lines, year, offset)
    return stamped.groupBy(F.col("log").alias("path")).agg(F.max_by("at_ms", "line_no").alias("at_ms"))


def shots(files: DataFrame) -> DataFrame:
    """Screenshots whose names carry ``MMDDYY_HHMMSS``."""
    digits = F.regexp_extract("name", r"_(\d{6}_\d{6})\.\w+$", 1)
    return files.where(digits != "").withColumn("at", F.unix_seconds(F.to_timestamp(digits, "MMddyy_HHmmss")))


def setting(texts: DataFrame, name: str) -> DataFrame:
    """One setting out of ``SET name "value"`` files: the newest file that mentions it decides.

    Without a mention the value is false; without any file it is null.
    """
    found = F.regexp_extract("text", rf'(?m)^SET {name} "([^"]*)"', 1)
    mentions = F.col("text").rlike(rf'(?m)^SET {name} "')
    told = texts.agg(F.max_by(F.when(mentions, found == "1"), F.when(mentions, F.col("modified_at"))).alias("v"), F.count("*").alias("n"))
    return told.select(F.when(F.col("n") > 0, F.coalesce("v", F.lit(False))).alias("value"))


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """All tables written under a new folder; a marker is written last, and readers ask for it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    spark.createDataFrame([(len(tables),)], "n_tables int").coalesce(1).write.mode("errorifexists").parquet(f"{folder}/_complete")
