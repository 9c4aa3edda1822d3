"""Combat logs: text lines to typed rows.

A line is ``M/D[/YYYY] HH:MM:SS.mmm[offset]  EVENT,field,...``. Stamps are read with column
functions; only the fields, whose quotes and brackets nest, are split in a vectorised UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from visitloom.operators.ranges import best_enclosing
from visitloom.session import ship

STAMP = r"^(\d{1,2})/(\d{1,2})(?:/(\d{2,4}))? (\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?([+-]?\d{1,4}(?::?\d{2})?)?  ([A-Z_]+)(?:,(.*))?$"


#: A quoted run, or one character that opens, closes or separates.
_MARKS = re.compile(r'"[^"]*"?|[()\[\],]')


def split_fields(text: str | None) -> list[str] | None:
    """Fields at the top level of commas; quotes hide everything, brackets nest."""
    if text is None:
        return None
    if not any(c in text for c in '"([)]'):
        return text.split(",")
    out, begin, depth = [], 0, 0
    for m in _MARKS.finditer(text):
        c = m[0][0]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth <= 0:
            out.append(text[begin : m.start()])
            begin = m.end()
    out.append(text[begin:])
    return [f[1:-1] if len(f) > 1 and f[0] == f[-1] == '"' else f for f in out]


def entries(inner: str | None) -> list[str]:
    """The fields of a ``[...]`` or ``(...)`` group; none of an empty group or another text."""
    if not inner or inner[0] + inner[-1] not in ("[]", "()") or len(inner) < 3:
        return []
    return split_fields(inner[1:-1])


@F.pandas_udf(T.ArrayType(T.StringType()))
def fields(texts: pd.Series) -> pd.Series:
    return texts.map(split_fields)


# else each later filter on fields would split the lines again, in a Python worker of its own
fields = fields.asNondeterministic()


@F.pandas_udf(T.ArrayType(T.StringType()))
def group(texts: pd.Series) -> pd.Series:
    """Fields of a bracketed field."""
    return texts.map(entries)


def offset_minutes(text: Column) -> Column:
    """Minutes east of UTC of a glued offset: ``h``, ``hh``, ``hhmm`` or ``hh:mm``, unsigned meaning east."""
    digits = F.regexp_replace(text, "[+:-]", "")
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    short = F.char_length(digits) <= 2
    hours = F.when(short, digits).otherwise(F.substring(digits, F.lit(1), F.char_length(digits) - 2)).try_cast("int")
    minutes = F.when(short, 0).otherwise(F.substring(digits, F.char_length(digits) - 1, F.lit(2)).try_cast("int"))
    return F.when(text != "", sign * (hours * 60 + minutes))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, line) of text files; line_no orders the lines of a file."""
    text = spark.read.text(path)
    return text.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("log"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def parse(lines: DataFrame, year: int, offset: int = 0, events: tuple[str, ...] | None = None) -> DataFrame:
    """Readable lines with month, day, event, fields and at_ms; others are left out.

    Lines without a year get ``year``; use operators.timeline.with_years on month to follow
    logs past December. ``offset`` is in minutes, for lines that name none. With ``events`` only
    lines of these are split and returned.
    """
    ship(lines.sparkSession)
    part = lambda i: F.regexp_extract("line", STAMP, i)
    told = lines.where(F.col("line").rlike(STAMP))
    y = part(3).try_cast("int")
    y = F.when(part(3) == "", year).when(y < 100, y + 2000).otherwise(y)
    micros = F.rpad(part(7), 6, "0").try_cast("long")
    stamp = F.try_make_timestamp_ntz(y, part(1).cast("int"), part(2).cast("int"), part(4).cast("int"), part(5).cast("int"), part(6).cast("int"))
    at = F.unix_millis(stamp.cast("timestamp")) + F.coalesce((micros / 1000).cast("long"), F.lit(0))
    at = at - F.coalesce(offset_minutes(part(8)), F.lit(offset)) * 60_000
    out = told.select(
        "log", "line_no", part(1).cast("int").alias("month"), part(2).cast("int").alias("day"), at.alias("at_ms"), part(9).alias("event"), part(10).alias("_rest")
    )
    wanted = F.lit(True) if events is None else F.col("event").isin(*events)
    return out.where(F.col("at_ms").isNotNull() & wanted).withColumn("fields", fields("_rest")).drop("_rest")


def number(field: Column) -> Column:
    """A number out of a field; ``nil`` and junk are absent, not zero."""
    return F.when(F.lower(field) != "nil", field.try_cast("double"))


def own_players(rows: DataFrame, flags: str = "flags", guid: str = "guid") -> DataFrame:
    """Rows about the local player: affiliation nibble 1 and a player's id."""
    mask = F.conv(F.regexp_replace(flags, "^0x", ""), 16, 10).cast("long")
    return rows.where((mask.bitwiseAND(0xF) == 1) & F.startswith(F.col(guid), F.lit("Player-")))


def marks(parsed: DataFrame) -> DataFrame:
    """START and END marks of encounters and keystones, for operators.timeline.folded_fights."""
    e = F.col("event")
    kind = F.when(e.startswith("ENCOUNTER"), "encounter").when(e.startswith("CHALLENGE_MODE"), "keystone")
    return parsed.where(kind.isNotNull() & (e.endswith("START") | e.endswith("END"))).select(
        "log", "line_no", kind.alias("kind"), number(F.get("fields", F.lit(0))).cast("long").alias("encounter_id"), F.col("at_ms").alias("at"),
        F.when(e.endswith("START"), "START").otherwise("END").alias("mark"), (number(F.get("fields", F.lit(4))) == 1).alias("success"),
    )


def maps(parsed: DataFrame) -> DataFrame:
    """MAP_CHANGE rows: id, name and bounds."""
    f = lambda i: F.get("fields", F.lit(i))
    told = parsed.where("event = 'MAP_CHANGE'")
    return told.select("log", "line_no", "at_ms", number(f(0)).cast("long").alias("map_id"), f(1).alias("name"), *[number(f(i + 2)).alias(c) for i, c in enumerate(("x0", "x1", "y0", "y1"))])


# Events with advanced fields, and where these begin among a line's fields.
_AFTER_SPELL = (
    "SPELL_DAMAGE", "SPELL_PERIODIC_DAMAGE", "SPELL_BUILDING_DAMAGE", "RANGE_DAMAGE", "DAMAGE_SPLIT", "DAMAGE_SHIELD",
    "SPELL_HEAL", "SPELL_PERIODIC_HEAL", "SPELL_CAST_SUCCESS", "SPELL_ENERGIZE", "SPELL_SUMMON", "SPELL_RESURRECT",
)
ADVANCED = dict.fromkeys(("SWING_DAMAGE", "SWING_DAMAGE_LANDED"), 8) | dict.fromkeys(_AFTER_SPELL, 11)
ADVANCED_FIELDS = 17
_DECIMAL = r"^\s*[+-]?(\d+\.\d*|\.\d+)\s*$"
_WHOLE_OR_NIL = r"^\s*([+-]?\d+|nil)\s*$"


def positions(parsed: DataFrame) -> DataFrame:
    """(log, line_no, at_ms, guid, actor, x, y, map_id, facing) of the local player.

    The advanced block names its unit, which is the line's source or its target; the flags beside
    that end say whose it is. The position is found by its shape in the block, two decimals, a
    map id or nil and a decimal, since its place has moved between versions.
    """
    start = F.create_map(*[F.lit(v) for kv in ADVANCED.items() for v in kv])[F.col("event")]
    told = parsed.withColumns({"_a": start, "_n": F.size("fields")}).where(F.col("_n") >= F.col("_a") + ADVANCED_FIELDS)
    field = lambda i: F.get("fields", i if isinstance(i, Column) else F.lit(i))
    subject = F.trim(field(F.col("_a")))
    side = F.when(F.trim(field(0)) == subject, 0).when(F.trim(field(4)) == subject, 4)
    told = told.withColumns({"guid": subject, "_s": side}).where("_s is not null")
    shape = lambda i: field(i).rlike(_DECIMAL) & field(i + 1).rlike(_DECIMAL) & field(i + 2).rlike(_WHOLE_OR_NIL) & field(i + 3).rlike(_DECIMAL)
    at = F.get(F.filter(F.sequence(F.col("_a") + 2, F.col("_n") - 4), shape), F.lit(0))
    told = told.withColumns({"flags": field(F.col("_s") + 2), "actor": field(F.col("_s") + 1)})
    told = own_players(told).withColumn("_p", at).where("_p is not null")
    here = lambda i: number(F.trim(field(F.col("_p") + i)))
    return told.select("log", "line_no", "at_ms", "guid", "actor", here(0).alias("x"), here(1).alias("y"), here(2).cast("long").alias("map_id"), here(3).alias("facing"))


def _whole(text: str) -> int | None:
    return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else None


def _combatant(found: list[str]) -> dict:
    """Spec, talents and worn items by their arrangement: groups come after the plain numbers, the
    first one holds the talents, the one whose entries hold groups themselves is what is worn."""
    groups = [i for i, f in enumerate(found) if f[:1] + f[-1:] in ("[]", "()")]
    first = groups[0] if groups else 0
    nested = [[e for e in entries(found[i]) if any(entries(x) or x in ("()", "[]") for x in entries(e))] for i in groups]
    worn = []
    for e in max(nested, key=len, default=[]):
        parts = entries(e)
        if (item := _whole(parts[0])) is not None:
            bonus = entries(parts[3]) if len(parts) > 3 else []
            worn.append({"item": item, "level": _whole(parts[1]) if len(parts) > 1 else None, "bonus": [b for b in map(_whole, bonus) if b is not None]})
    return {"spec_id": _whole(found[first - 1]) if first >= 1 else None, "n_talents": len(entries(found[first])) if groups else 0, "worn": worn}


_WORN = T.StructType().add("item", T.LongType()).add("level", T.LongType()).add("bonus", T.ArrayType(T.LongType()))


@F.pandas_udf(T.StructType().add("spec_id", T.LongType()).add("n_talents", T.IntegerType()).add("worn", T.ArrayType(_WORN)))
def _combatant_of(found: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_combatant(list(f)) for f in found], columns=["spec_id", "n_talents", "worn"]).astype({"spec_id": "Int64"})


def combatants(parsed: DataFrame) -> DataFrame:
    """COMBATANT_INFO rows: who took part, with side, spec, number of talents, worn items and their mean level."""
    told = parsed.where((F.col("event") == "COMBATANT_INFO") & (F.trim(F.get("fields", F.lit(0))) != "")).withColumn("_c", _combatant_of("fields"))
    levels = F.filter(F.transform("_c.worn", lambda w: w["level"]), lambda v: v > 0)
    mean = F.when(F.size(levels) > 0, F.aggregate(levels, F.lit(0).cast("long"), lambda a, v: a + v) / F.size(levels))
    return told.select(
        "log", "line_no", "at_ms", F.trim(F.get("fields", F.lit(0))).alias("guid"), number(F.get("fields", F.lit(1))).cast("long").alias("faction"),
        "_c.spec_id", "_c.n_talents", "_c.worn", F.round(mean, 2).alias("item_level"),
    )


def attached(combatants: DataFrame, fights: DataFrame) -> DataFrame:
    """Combatants with the fight they took part in: the newest one open at their line, a boss before a run.

    ``fights`` has log, kind, line_no of its START and last_line of its END (null while open).
    """
    f = fights.select("log", F.col("line_no").alias("fight_line"), F.col("kind").alias("fight_kind"), "last_line")
    rank = F.struct((F.col("fight_kind") == "encounter").alias("boss"), F.col("fight_line"))
    return best_enclosing(combatants.select("log", "line_no", "guid").distinct(), f, ["log"], "line_no", "fight_line", "last_line", rank, ["fight_kind", "fight_line"])
