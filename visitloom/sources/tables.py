"""Tables of a data folder, and the relations that operators expect, derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; column pruning and predicates reach its Parquet scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table as a stream of its files, whether it is one file or a folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    one = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if one else reader.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str) -> None:
    """All tables as temporary views."""
    for name in TABLES:
        table(spark, folder, name).createOrReplaceTempView(name)


def seconds(ts):
    return F.unix_seconds(ts.cast("timestamp"))


def visits(spark: SparkSession, folder: str) -> DataFrame:
    """Visits out of the events table: who was where, from when to when, at which level."""
    e = table(spark, folder, "events")
    start = seconds(F.col("ts"))
    spent = F.floor(F.col("value") * 10).cast("long")
    return e.select(
        F.col("event_id").alias("visit_id"),
        F.col("user_id").alias("actor"),
        F.col("event_type").alias("place"),
        start.alias("started_at"),
        (start + spent).alias("ended_at"),
        spent.alias("seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("level"),
        F.date_format(F.timestamp_seconds(start + spent), "yyyy-MM-dd").alias("day"),
        F.floor(F.col("value") * 100).cast("long").alias("loot"),
    )


def catalog(spark: SparkSession, folder: str, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row a column of every table: type, position, whether it is a key, and the table's rows.

    Counting reads no column; it comes from the Parquet footers.
    """
    keys = keys or {}
    out = None
    for name in TABLES:
        df = table(spark, folder, name)
        cols = [(name, i, f.name, f.dataType.simpleString(), f.name in keys.get(name, ())) for i, f in enumerate(df.schema)]
        one = spark.createDataFrame(cols, "table_name string, position int, column_name string, kind string, primary_key boolean")
        one = one.crossJoin(df.agg(F.count("*").alias("row_count")))
        out = one if out is None else out.unionByName(one)
    return out


def relations(spark: SparkSession, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row a column of every relation that a session can ask: tables with their rows, views without.

    A view is listed, since a question may name it, but not counted, since that would run it.
    """
    keys = keys or {}
    kind = "table_name string, is_view boolean, position int, column_name string, kind string, primary_key boolean"
    out = spark.createDataFrame([], kind).withColumn("row_count", F.lit(None).cast("long"))
    for t in sorted(spark.catalog.listTables(), key=lambda t: t.name):
        view = t.isTemporary or t.tableType == "VIEW"
        df = spark.table(f"`{t.name}`")
        cols = [(t.name, view, i, f.name, f.dataType.simpleString(), f.name in keys.get(t.name, ())) for i, f in enumerate(df.schema)]
        one = spark.createDataFrame(cols, kind)
        one = one.withColumn("row_count", F.lit(None).cast("long")) if view else one.crossJoin(df.agg(F.count("*").alias("row_count")))
        out = out.unionByName(one)
    return out
