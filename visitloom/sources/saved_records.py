"""Saved-variable files: ``Name = { ... }`` tables to nested rows.

A file is small and read whole; its table becomes JSON in a vectorised UDF and Spark's
``from_json`` gives it types. Unknown fields are ignored, malformed fields are absent, entries
without their id are dropped without their siblings.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.scratch import Rounds
from visitloom.session import ship

#: White space and comments, then one token; any other character is unreadable.
_LEX = re.compile(
    r"""(?:\s+|--\[\[.*?\]\]|--[^\n]*)*(\[\[.*?\]\]|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|-?0[xX][0-9a-fA-F]+|-?\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|[{}\[\]=,;]|.|\Z)""",
    re.S,
)
_WORDS = {"true": True, "false": False, "nil": None}
_ESCAPED = re.compile(r"\\(\d{1,3}|.)", re.S)
#: A key that is being read: between its brackets.
_KEY = object()


def _unescaped(m: re.Match) -> str:
    return {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], chr(int(m[1])) if m[1].isdigit() else m[1])


def _scalar(raw: str):
    first = raw[0]
    if first in "\"'":
        if len(raw) < 2:
            raise ValueError("an open quote")
        return _ESCAPED.sub(_unescaped, raw[1:-1]) if "\\" in raw else raw[1:-1]
    if first == "[":
        return raw[2:-2]
    if raw.isdecimal():
        return int(raw)
    if first == "-" or first.isdecimal():
        return int(raw, 16) if "x" in raw.lower() else float(raw) if any(c in raw for c in ".eE") else int(raw)
    if first == "_" or first.isalpha():
        return _WORDS.get(raw, raw)
    raise ValueError(f"unreadable: {raw}")


def _closed(table: dict):
    if 1 in table and list(table) == list(range(1, len(table) + 1)):
        return list(table.values())
    return {str(k): v for k, v in table.items()}


def to_value(text: str, name: str):
    """The table of that name as dicts and lists, or None when it is missing or unreadable.

    A table whose keys are 1..n is a list; an empty one is an empty dict.
    """
    found = re.search(rf"(?m)^\s*{re.escape(name)}\s*=", text or "")
    if not found:
        return None
    above: list[tuple] = []  # of the tables around: table, its key to come, its highest number
    table = key = top = None
    inside = False  # between the brackets of a key
    try:
        for m in _LEX.finditer(text, found.end()):
            raw = m[1]
            if raw == "{":
                above.append((table, key, top, inside))
                table, key, top, inside = {}, None, None, False
                continue
            if raw in ("=", ",", ";"):
                continue
            if raw == "[" or raw == "]":
                if table is None:
                    return None
                if raw == "[":
                    key, inside = (_KEY,), True
                else:
                    inside = False
                continue
            if raw == "}":
                if table is None:
                    return None
                value = _closed(table)
                table, key, top, inside = above.pop()
            elif not raw:
                return None
            else:
                value = _scalar(raw)
                if table is not None and raw not in _WORDS and (raw[0] == "_" or raw[0].isalpha()):
                    key, inside = (value,), False
                    continue
            if table is None:
                return value
            if inside:
                key = (value,)
                continue
            at = (1 if top is None else top + 1) if key is None else key[0]
            if isinstance(at, int) and (top is None or at > top):
                top = at
            table[at] = value
            key = None
    except (ValueError, TypeError):
        return None
    return None


def read(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """One row a file: its path, modification time and the named table under a DDL schema."""
    files = spark.read.format("binaryFile").load(path)
    return parsed(files, "content", name, schema).select("path", "modificationTime", "length", "record")


def parsed(texts: DataFrame, column: str, name: str, schema: str) -> DataFrame:
    """Rows with ``record`` in place of a text or binary column: its named table, under a DDL schema.

    Operators read records several times over; so that each text is parsed once, records are
    written to the shared folder. Rows come by the partitions of ``texts``, which decide how many
    tasks parse.
    """
    ship(texts.sparkSession)

    @F.pandas_udf(T.StringType())
    def as_json(contents: pd.Series) -> pd.Series:
        told = contents.map(lambda b: to_value(b if isinstance(b, str) else bytes(b).decode("utf-8", "replace"), name))
        return told.map(lambda v: None if v is None else json.dumps(v))

    told = texts.withColumn("record", F.from_json(as_json(column), schema, {"mode": "PERMISSIVE"})).drop(column)
    return Rounds(texts.sparkSession, "records").save(told)


def changed(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose modification time or length differ from what the manifest last saw."""
    same = ["path", "modificationTime", "length"]
    return listing.join(manifest.select(*same), same, "left_anti")


def entries(records: DataFrame, name: str, required: tuple[str, ...], source: str = "path") -> DataFrame:
    """One row for each entry of a list that has its required fields, with its position."""
    told = records.select(source, F.posexplode(f"record.{name}").alias("position", "e")).select(source, "position", "e.*")
    for c in required:
        told = told.where(F.col(c).isNotNull())
    return told


#: DDL types of what a file holds beside its segments.
MARKERS = "struct<entries: array<struct<id: string, at: bigint, trigger: string, note: string, segmentId: string>>>"
HOLDINGS = (
    "struct<characters: map<string, struct<updatedAt: bigint, gold: struct<total: bigint, at: bigint>,"
    " currencies: map<string, struct<name: string, total: bigint, accountWide: boolean, at: bigint>>,"
    " factions: map<string, struct<name: string, standing: string, current: bigint, max: bigint, rank: bigint, system: string, accountWide: boolean, at: bigint>>>>>"
)
_STATE = "struct<complete: boolean, revision: bigint, held: bigint, counted: bigint, by: string, completedAt: bigint, entries: map<string, struct<name: string, count: bigint>>>"
CENSUS = f"struct<account: map<string, {_STATE}>, characters: map<string, map<string, {_STATE}>>>"


def markers(records: DataFrame, source: str = "path") -> DataFrame:
    """Capture markers: entries with an id and a time."""
    return entries(records, "entries", ("id", "at"), source)


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """Rows whose text key is a whole number, as that number."""
    return rows.withColumn(name, F.col(name).try_cast("bigint")).where(F.col(name).isNotNull())


def wallets(records: DataFrame, source: str = "path") -> DataFrame:
    """(source, character, gold, at) of each character's last gold reading."""
    told = records.select(source, F.explode("record.characters").alias("character", "h"))
    return told.where("h.gold.total >= 0").select(source, "character", F.col("h.gold.total").alias("gold"), F.col("h.gold.at").alias("at"))


def held_currencies(records: DataFrame, source: str = "path") -> DataFrame:
    """(source, character, currency_id, name, total, shared, at)."""
    told = records.select(source, F.explode("record.characters").alias("character", "h"))
    told = _numbered(told.select(source, "character", F.explode("h.currencies").alias("currency_id", "c")), "currency_id")
    return told.where("c.total is not null").select(
        source, "character", "currency_id", "c.name", "c.total", F.coalesce("c.accountWide", F.lit(False)).alias("shared"), "c.at"
    )


def held_standings(records: DataFrame, source: str = "path") -> DataFrame:
    """(source, character, faction_id, name, standing, current, max, rank, system, shared, at)."""
    told = records.select(source, F.explode("record.characters").alias("character", "h"))
    told = _numbered(told.select(source, "character", F.explode("h.factions").alias("faction_id", "f")), "faction_id")
    shared = F.coalesce("f.accountWide", F.lit(False)).alias("shared")
    return told.where("f.standing is not null or f.rank is not null").select(
        source, "character", "faction_id", *[f"f.{c}" for c in ("name", "standing", "current", "max", "rank", "system")], shared, "f.at"
    )


# Domains that belong to a character, and those that a walk may only add to.
OF_CHARACTERS = ("titles", "currencies", "reputations")
GROW_ONLY = ("appearances", "toys", "heirlooms")


def _census_states(records: DataFrame, source: str) -> DataFrame:
    account = records.select(source, F.lit(None).cast("string").alias("character"), F.explode("record.account").alias("domain", "s"))
    own = records.select(source, F.explode("record.characters").alias("character", "d")).select(source, "character", F.explode("d").alias("domain", "s"))
    return account.unionByName(own)


def census_claims(records: DataFrame, source: str = "path") -> DataFrame:
    """One claim for each walked domain, of the account or of a character."""
    told = _census_states(records, source)
    zero = lambda c: F.coalesce(f"s.{c}", F.lit(0)).alias(c)
    return told.select(
        source, "character", "domain", F.coalesce("s.complete", F.lit(False)).alias("complete"), zero("revision"), zero("held"), F.col("s.counted").alias("counted"),
        F.col("domain").isin(*GROW_ONLY).alias("grow_only"),
    )


def census_entries(records: DataFrame, source: str = "path") -> DataFrame:
    """(source, character, domain, entry_id, name, n): what the walks met.

    Entries of a character's domain that were filed against the account have no owner and are
    left out, their claims stay. A missing count is zero.
    """
    told = _census_states(records, source).where(F.col("character").isNotNull() | ~F.col("domain").isin(*OF_CHARACTERS))
    told = _numbered(told.select(source, "character", "domain", F.explode("s.entries").alias("entry_id", "e")), "entry_id")
    return told.select(source, "character", "domain", "entry_id", F.col("e.name").alias("name"), F.coalesce("e.count", F.lit(0)).alias("n"))


#: Lists of a segment: the fields of their entries.
LISTS = {
    "transmogs": "id: bigint, at: bigint, sourceID: bigint, appearanceID: bigint, newAppearance: boolean",
    "currencies": "id: bigint, name: string, amount: bigint, total: bigint",
    "reputation": "faction: string, id: bigint, accountWide: boolean, amount: bigint, standing: string, current: bigint, max: bigint, rank: bigint, system: string",
    "achievements": "id: bigint, name: string, at: bigint, accountFirst: boolean",
    "levelUps": "level: bigint, at: bigint",
    "mounts": "id: bigint, name: string, at: bigint, guid: string",
    "pets": "id: bigint, name: string, at: bigint, guid: string, speciesFirst: boolean",
    "toys": "id: bigint, name: string, at: bigint, guid: string",
    "quests": "id: bigint, at: bigint, name: string, characterFirst: boolean, accountFirst: boolean",
    "housingItems": "id: bigint, name: string, at: bigint, warbandFirst: boolean",
    "housingLevelUps": "level: bigint, at: bigint",
    "encounters": "id: bigint, name: string, at: bigint, difficultyId: bigint, groupSize: bigint, success: boolean",
    "equipsetChanges": "setId: bigint, name: string, kind: string, at: bigint, items: array<struct<slot: bigint, itemId: bigint, itemLevel: bigint, itemName: string>>",
}
#: DDL type of one segment
SEGMENT = (
    "struct<id: string, character: string, classFile: string, level: bigint, instance: string, instanceType: string, difficulty: string, difficultyId: bigint,"
    " startedAt: bigint, endedAt: bigint, seconds: bigint, lootValue: bigint, goldDiff: bigint, expansionTier: bigint, latestExpansionTier: bigint,"
    + "".join(f" {name}: array<struct<{fields}>>," for name, fields in LISTS.items())
    + " keystone: struct<level: bigint, mapId: bigint, affixes: array<bigint>, startedAt: bigint, completedAt: bigint, completed: boolean, durationMs: bigint, onTime: boolean, upgrades: bigint>,"
    " delve: struct<tier: bigint, scenarioId: bigint, startedAt: bigint, completedAt: bigint, completed: boolean>,"
    " experience: struct<gained: bigint, percent: double, startLevel: bigint, endLevel: bigint>>"
)


def events_of(segments: DataFrame, name: str, key: str = "id") -> DataFrame:
    """(segment, position, fields) of one list of the segments; entries without an id keep their place."""
    return segments.select(F.col(key).alias("segment_id"), F.posexplode(name).alias("position", "e")).select("segment_id", "position", "e.*")


def normalise(segments: DataFrame) -> DataFrame:
    """Typed visits: rows without id, character or end are dropped, the rest get their defaults."""
    told = segments.where(F.col("id").isNotNull() & F.col("character").isNotNull() & F.col("endedAt").isNotNull())
    start = F.coalesce("startedAt", "endedAt")
    return told.withColumns({
        "instance": F.coalesce("instance", F.lit("Unknown")), "instanceType": F.coalesce("instanceType", F.lit("none")), "difficulty": F.coalesce("difficulty", F.lit("")),
        "startedAt": start, "seconds": F.coalesce("seconds", F.lit(0)), "day": F.date_format(F.timestamp_seconds("endedAt"), "yyyy-MM-dd"),
    })
