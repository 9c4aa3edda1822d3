"""A folder of tables that is written one sync at a time, by any number of writers.

A table is cut in buckets by a hash of its key. A sync writes the buckets that it changes to folders
of its own and then one small state, which names the folder of every bucket; buckets that it does
not touch keep theirs. Readers ask the newest state, so they see a whole sync or none. States are
numbered, and a number can be taken only once: of two writers that began from one state, the
second to finish gets a ``Conflict``, and what it wrote goes. A sync that stopped half-way leaves no
state, and is run again. States are created exclusively, which HDFS and stores with conditional
writes do atomically.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom import schema
from visitloom.operators.merge import upsert
from visitloom.sources.saved_records import changed

BUCKETS = 64
#: The table of files that were read, committed with what was read from them.
FILES = "_files"
_EMPTY = {"sync": 0, "tables": {}, "applied": [], "done": True}


class Conflict(RuntimeError):
    """Another writer committed a sync since this one began; run it again."""


def bucket_of(keys: list[str], buckets: int) -> Column:
    """Null keys have a bucket too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class Store:
    """Tables under ``root``, any folder that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _listed(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _state(self, number: int) -> dict | None:
        """The state of that number, None if its writer stopped before its end."""
        fs, where = self._fs(f"{self.root}/state/{number}")
        stream = fs.open(where)
        try:
            text = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
        try:
            told = json.loads(text)
        except ValueError:
            return None
        return told if told.get("done") else None

    def _numbers(self) -> list[int]:
        return sorted((int(n) for n in self._listed(f"{self.root}/state") if n.isdigit()), reverse=True)

    def state(self) -> dict:
        """The newest whole state: its sync's number, the tables' buckets and the applied migrations."""
        for number in self._numbers():
            if told := self._state(number):
                return told
        return json.loads(json.dumps(_EMPTY))

    def _commit(self, state: dict, number: int) -> None:
        fs, where = self._fs(f"{self.root}/state/{number}")
        try:
            out = fs.create(where, False)  # fails if another writer took the number
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"sync {number} was committed by another writer") from None
            raise
        out.write(bytearray(json.dumps({**state, "sync": number, "done": True}).encode()))
        out.close()

    def _read(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        held = {table["buckets"][b] for b in (range(len(table["buckets"])) if buckets is None else buckets)} - {None}
        kind = T.StructType.fromJson(table["schema"])
        if not held:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in sorted(held)])

    def tables(self) -> dict[str, DataFrame]:
        return {n: self._read(t) for n, t in self.state()["tables"].items()}

    def _written(self, name: str, df: DataFrame, keys: list[str], buckets: int) -> dict[int, str]:
        """The folders of the buckets of these rows, written."""
        folder = f"{name}/{uuid.uuid4().hex}"
        cut = df.withColumn("_bucket", bucket_of(keys, buckets) if keys else F.lit(0)).repartition("_bucket")
        cut.write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        names = [n for n in self._listed(f"{self.root}/{folder}") if n.startswith("_bucket=")]
        return {int(n.partition("=")[2]): f"{folder}/{n}" for n in names}

    def _take(self, write: Callable[[dict], dict]) -> dict:
        """Commit what ``write`` makes of the newest state; what it wrote goes if it can't be committed."""
        now = self.state()
        number = max([now["sync"], *self._numbers()[:1]]) + 1
        state = write(json.loads(json.dumps(now)))
        before = {f for t in now["tables"].values() for f in t["buckets"]}
        try:
            self._commit(state, number)
        except Conflict:
            for f in {f for t in state["tables"].values() for f in t["buckets"]} - before - {None}:
                fs, where = self._fs(f"{self.root}/{f.rpartition('/')[0]}")
                fs.delete(where, True)
            raise
        return state

    def sync(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Write the tables that ``change`` makes out of the present ones; the others stay as they are.

        Migrations that are not yet applied come first, in the same sync. These tables are written
        whole; ``merge`` writes only the buckets that a batch touches.
        """

        def write(state: dict) -> dict:
            before = {n: self._read(t) for n, t in state["tables"].items()}
            tables, state["applied"] = schema.migrate(before, state["applied"])
            tables = {**tables, **change(tables)}
            for name, df in tables.items():
                if df is not before.get(name):
                    told = state["tables"].get(name, {})
                    keys = told.get("keys") or [k for k in schema.KEYS.get(name, ()) if set(schema.KEYS[name]) <= set(df.columns)]
                    n = len(told.get("buckets", [])) or (BUCKETS if keys else 1)
                    held = self._written(name, df, keys, n)
                    state["tables"][name] = {"keys": keys, "schema": df.schema.jsonValue(), "buckets": [held.get(b) for b in range(n)]}
            return state

        self._take(write)
        return self.tables()

    def merge(self, batches: dict[str, DataFrame], keys: dict[str, list[str]] | None = None, rules: dict[str, dict] | None = None) -> list[str]:
        """Upsert batches by their tables' keys (given, or of the schema); rewrites touched buckets only.

        All batches are one sync. Returns the folders that it wrote. Columns that a table has not got
        yet are added, null in buckets that were not touched.
        """
        wrote: list[str] = []

        def write(state: dict) -> dict:
            for name, batch in batches.items():
                key = list((keys or {}).get(name) or schema.KEYS[name])
                told = state["tables"].get(name) or {"keys": key, "schema": batch.schema.jsonValue(), "buckets": [None] * BUCKETS}
                if told["keys"] != key:
                    raise ValueError(f"{name} is kept by {told['keys']}")
                n = len(told["buckets"])
                touched = sorted(r[0] for r in batch.select(bucket_of(key, n)).distinct().collect())  # n numbers at most
                old = self._read(told, touched)
                for c, kind in batch.dtypes:
                    old = old if c in old.columns else old.withColumn(c, F.lit(None).cast(kind))
                for c, kind in old.dtypes:
                    batch = batch if c in batch.columns else batch.withColumn(c, F.lit(None).cast(kind))
                made = upsert(old, batch.select(*old.columns), key, (rules or {}).get(name))
                held = self._written(name, made, key, n)
                wrote.extend(held.values())
                buckets = [held.get(b) if b in touched else f for b, f in enumerate(told["buckets"])]
                state["tables"][name] = {"keys": key, "schema": made.schema.jsonValue(), "buckets": buckets}
            return state

        self._take(write)
        return wrote

    def merge_files(self, path: str, read: Callable[[DataFrame], dict[str, DataFrame]], keys: dict[str, list[str]] | None = None, rules: dict[str, dict] | None = None) -> list[str]:
        """Merge what ``read`` makes of the files that changed; returns their paths.

        A file is known by path, modification time and length. The list of files that were read is
        a table of the store, committed in the same sync, so a sync that stops reads its files again
        and one that ends never does. Contents of unchanged files are not opened.
        """
        listing = self.spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
        held = self.state()["tables"].get(FILES)
        fresh = changed(listing, self._read(held)) if held else listing
        paths = [r["path"] for r in fresh.select("path").collect()]  # Spark lists files on the driver as well
        if paths:
            files = self.spark.read.format("binaryFile").load(paths)
            seen = files.select("path", "modificationTime", "length")
            self.merge({**read(files), FILES: seen}, {**(keys or {}), FILES: ["path"]}, rules)
        return paths

    def tidy(self) -> None:
        """Delete bucket folders and states that the present state does not name; not beside a running sync."""
        now = self.state()
        named = {f for t in now["tables"].values() for f in t["buckets"]} - {None}
        for table in now["tables"]:
            for folder in self._listed(f"{self.root}/{table}"):
                parts = self._listed(f"{self.root}/{table}/{folder}")
                for part in [p for p in parts if p.startswith("_bucket=") and f"{table}/{folder}/{p}" not in named]:
                    fs, where = self._fs(f"{self.root}/{table}/{folder}/{part}")
                    fs.delete(where, True)
                if not any(f.startswith(f"{table}/{folder}/") for f in named):
                    fs, where = self._fs(f"{self.root}/{table}/{folder}")
                    fs.delete(where, True)
        for number in self._numbers():
            if number != now["sync"]:
                fs, where = self._fs(f"{self.root}/state/{number}")
                fs.delete(where, True)


def history_summary(segments: DataFrame, characters: DataFrame, captures: DataFrame) -> DataFrame:
    """What an arriving history holds: counts of visits, characters and captures, and its newest day."""
    told = segments.agg(F.count("*").alias("segments"), F.max("ended_day").alias("newest_day"))
    return told.crossJoin(characters.agg(F.count("*").alias("characters"))).crossJoin(captures.agg(F.count("*").alias("captures")))  # one row each


def lua_text(text):
    """A text as a quoted Lua string."""
    out = text
    for plain, quoted in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(quoted))
    return F.concat(F.lit('"'), out, F.lit('"'))


def lua_requests(requests: DataFrame, slots: DataFrame, issued_at: int, name: str = "customSetRequests") -> DataFrame:
    """Requests as the lines (value) of a Lua module that the game reads back.

    ``requests`` has id, name and icon, ``slots`` request_id, slot, appearance, secondary and
    illusion. What is null is left out. Lines carry ``ord`` and come in its order.
    """

    def pair(key: str, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f'["{key}"] = '), value.cast("string")))

    def table(*pairs):
        return F.concat(F.lit("{ "), F.concat_ws(", ", *pairs), F.lit(" }"))

    one = table(*[pair(k, F.col(k)) for k in ("slot", "appearance", "secondary", "illusion")])
    worn = slots.groupBy(F.col("request_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", one.alias("text")))).alias("_worn"))
    listed = F.concat(F.lit("{ "), F.array_join(F.transform(F.coalesce("_worn", F.array().cast("array<struct<slot:int,text:string>>")), lambda w: w["text"]), ", "), F.lit(" }"))
    told = requests.join(worn, "id", "left")
    line = table(pair("id", F.col("id")), pair("name", lua_text(F.coalesce("name", F.lit("")))), pair("icon", F.col("icon")), F.concat(F.lit('["slots"] = '), listed))
    body = told.select(F.struct(F.lit(1).alias("part"), F.col("id").cast("long").alias("id")).alias("ord"), F.concat(F.lit("        "), line, F.lit(",")).alias("value"))
    spark = requests.sparkSession
    frame = [(0, "local _, ns = ..."), (1, f"ns.{name} = {{"), (2, f'    ["issuedAt"] = {issued_at},'), (3, '    ["requests"] = {')]
    head = spark.createDataFrame(frame, "id long, value string").select(F.struct(F.lit(0).alias("part"), "id").alias("ord"), "value")
    tail = spark.createDataFrame([(0, "    },"), (1, "}")], "id long, value string").select(F.struct(F.lit(2).alias("part"), "id").alias("ord"), "value")
    return head.unionByName(body).unionByName(tail).orderBy("ord")
