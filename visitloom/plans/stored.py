"""What is kept between reads: synced tables, migrations, tailed logs, merged streams, and asked questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom import schema
from visitloom import workbench as WB
from visitloom.plans.base import VISITS, query
from visitloom.plans.recipes import register_history
from visitloom.scratch import Rounds
from visitloom.sources import folders
from visitloom.sources.store import Store
from visitloom.sources.tables import stream, table
from visitloom.streaming import jobs
from visitloom.streaming.tail import TailSource


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS price, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS seen FROM orders")
def synced_orders(spark, d):
    """Orders synced to a store, then the open ones again: only the buckets that these touch are rewritten."""
    store, key = Store(spark, Rounds(spark, "store").root), {"orders": ["o_orderkey"]}
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lit(1).alias("seen"))
    store.merge({"orders": orders.withColumn("price", F.lit(0.0))}, key)
    store.merge({"orders": orders.where("status <> 'O'")}, key)
    store.merge({"orders": orders.where("status = 'O'").withColumn("seen", F.lit(2))}, key)
    return store.tables()["orders"]


@query("""SELECT 'tag' AS held, 'set' AS kind, p_partkey AS id, p_brand AS text, NULL::BIGINT AS extra FROM part
UNION ALL SELECT 'gain', NULL, o_orderkey, o_orderstatus, 0 FROM orders""")
def migrated_tables(spark, d):
    """Tables of an old store after all migrations: tags copied under a wider key, visits widened by a default."""
    old = {
        "transmog_tags": table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("text")),
        "segments": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("text")),
    }
    store = Store(spark, Rounds(spark, "store").root)
    held = store.sync(lambda _: schema.migrate(old, [])[0])
    tags = held["transmog_tags"].select(F.lit("tag").alias("held"), "kind", "id", "text", F.lit(None).cast("long").alias("extra"))
    return tags.unionByName(held["segments"].select(F.lit("gain").alias("held"), F.lit(None).cast("string").alias("kind"), "id", "text", F.col("experience_gained").alias("extra")))


@query("SELECT event_id, event_type FROM events")
def tailed_log(spark, d):
    """Events as growing text files, tailed by byte ranges; the folder must be one that executors can open."""
    root = Rounds(spark, "tail").root
    lines = table(spark, d, "events").select(F.concat_ws("|", F.col("event_id").cast("string"), "event_type").alias("value"))
    lines.write.text(f"{root}/logs")
    spark.dataSource.register(TailSource)
    tailed = spark.readStream.format("tail").option("path", f"{root}/logs".removeprefix("file://")).option("prefix", "part-").option("piece", 1 << 20).option("budget", 1 << 40).load()
    told = jobs.drained(tailed.select("line"), "tailed")
    parts = F.split("line", "[|]")
    return told.select(parts[0].cast("long").alias("event_id"), parts[1].alias("event_type"))


@query("SELECT user_id % 7 AS log, arg_max(epoch_us(ts) // 1000, event_id) AS at_ms FROM events GROUP BY 1")
def tail_stamps(spark, d):
    """Events as logs on disk, and when each was last written, out of its last bytes alone."""
    root = Rounds(spark, "stamps").root
    stamp = F.date_format(F.col("ts").cast("timestamp"), "M/d/yyyy HH:mm:ss.SSS")
    lines = table(spark, d, "events").select((F.col("user_id") % 7).alias("log"), "event_id", F.concat(stamp, F.lit("  EVENT,"), "event_id").alias("value"))
    lines.repartition("log").sortWithinPartitions("log", "event_id").drop("event_id").write.partitionBy("log").text(f"{root}/logs")
    files = folders.listing(spark, f"{root}/logs", "part-*")
    told = folders.tail_stamps(files, 2024)
    return told.select(F.regexp_extract("path", r"log=(\d+)", 1).cast("long").alias("log"), "at_ms")


@query("SELECT event_id, user_id, event_type, value FROM events")
def merged_stream(spark, d):
    """A stream merged into a store batch by batch, each batch twice as a replay would: the same rows."""
    store, root = Store(spark, Rounds(spark, "store").root), Rounds(spark, "merging").root
    rows = stream(spark, d, "events").select("event_id", "user_id", "event_type", "value")

    def merge(batch, _):
        for _ in range(2):
            store.merge({"events": batch}, {"events": ["event_id"]})

    jobs.merging(rows, merge, root).awaitTermination()
    return store.tables()["events"]


@query("SELECT event_id, event_type FROM events")
def deduplicated_stream(spark, d):
    """A stream in which every event comes twice, each kept once."""
    rows = stream(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return jobs.drained(jobs.deduplicated(twice, ["event_id"], "at", "3650 days").select("event_id", "event_type"), "deduplicated")


@query(f"WITH {VISITS} SELECT place AS kind, count(*) AS stays, max(loot) AS most FROM visits JOIN customer ON actor = c_custkey GROUP BY place")
def asked_question(spark, d):
    """A question asked through the workbench's gate and limits; its answer as a table."""
    own = WB.copied(spark)
    register_history(own, d)
    answer = WB.ask(own, "SELECT kind, count(*) AS stays, max(taken) AS most FROM stays GROUP BY kind", seconds=600, relations={"stays"})
    return spark.createDataFrame([tuple(r) for r in answer.rows], "kind string, stays long, most long")
