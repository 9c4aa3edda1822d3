"""Tables that an operator writes between its rounds, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from visitloom.session import shared_dir


class Rounds:
    """Written tables cut lineage and survive lost executors; they go when the driver's Python ends.

    What an operator returns may still read its last tables; ``close`` deletes them sooner.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.saved = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str | None = None) -> DataFrame:
        self.saved += 1
        name = name or f"table_{self.saved}"
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self, *names: str) -> None:
        """Delete the named tables, or all."""
        try:
            for where in [f"{self.root}/{n}" for n in names] or [self.root]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session and its JVM may be gone already
            pass
