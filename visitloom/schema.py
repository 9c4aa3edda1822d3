"""Keys and references of the analytics tables, for checks and cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: table -> columns that identify a row
KEYS = {
    "accounts": ("source_key",), "characters": ("account_id", "source_key"), "segments": ("character_id", "source_id"),
    "encounters": ("segment_id", "position"), "quests": ("segment_id", "position"), "achievements": ("segment_id", "position"),
    "currency_gains": ("segment_id", "currency_id"), "reputation_gains": ("segment_id", "faction"), "keystone_runs": ("segment_id",), "delve_runs": ("segment_id",),
    "activity_suppressions": ("segment_id", "kind"), "lockouts": ("activity_id", "character_id", "difficulty_id"), "equipset_slots": ("change_id", "slot"),
    "captures": ("source_id",), "combat_logs": ("name",), "log_positions": ("log_id", "at_ms", "actor"), "log_fights": ("log_id", "kind", "encounter_id", "started_at"),
    "log_combatants": ("fight_id", "guid"), "census_domains": ("account_id", "domain", "character_id"),
}
#: parent table, parent key, child table, child column, what a delete does to the child
REFERENCES = [
    ("accounts", "id", "characters", "account_id", "delete"), ("characters", "id", "segments", "character_id", "delete"),
    ("segments", "id", "encounters", "segment_id", "delete"), ("segments", "id", "quests", "segment_id", "delete"),
    ("segments", "id", "currency_gains", "segment_id", "delete"), ("segments", "id", "keystone_runs", "segment_id", "delete"),
    ("segments", "id", "captures", "segment_id", "null"), ("combat_logs", "id", "log_positions", "log_id", "delete"), ("combat_logs", "id", "log_fights", "log_id", "delete"),
]


def _with(table: str, **columns: str):
    """A step that widens a table by columns, null in the rows that are there (or a default after ``=``)."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if table not in tables:
            return tables
        added = {}
        for name, kind in columns.items():
            kind, _, default = kind.partition("=")
            added[name] = F.lit(default or None).cast(kind)
        return {**tables, table: tables[table].withColumns({n: c for n, c in added.items() if n not in tables[table].columns})}

    return step


def _copied(table: str, key: str, fill: dict[str, str]):
    """A step that copies a table into a wider one whose key has a further part, the same for all old rows."""

    def step(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if table not in tables or key in tables[table].columns:
            return tables
        old = tables[table]
        return {**tables, table: old.select(*[F.lit(v).alias(k) for k, v in fill.items()], *old.columns)}

    return step


#: ordered, named, once-only steps from table dictionaries to table dictionaries
MIGRATIONS: list[tuple[str, object]] = [
    ("activities", _with("segments", expansion_tier="bigint", latest_expansion_tier="bigint", experience_gained="bigint=0", experience_percent="double=0", experience_start_level="bigint", experience_end_level="bigint")),
    ("holdings", _with("currency_gains", total="bigint")),
    ("standings", _with("reputation_gains", standing="string", standing_current="bigint", standing_max="bigint")),
    ("capture_subjects", _with("captures", trigger_name="string", achievement_source_id="bigint", achievement_id="bigint")),
    ("capture_notes", _with("captures", note="string", note_edited_at="bigint")),
    ("account_wide_currencies", _with("character_currencies", account_wide="boolean=false")),
    ("pet_species_first", _with("pets", species_first="boolean")),
    ("favourites_of_kinds", _copied("transmog_favourites", "kind", {"kind": "set"})),
    ("tags_of_kinds", _copied("transmog_tags", "kind", {"kind": "set"})),
    ("faction_ids", _with("reputation_gains", faction_id="bigint")),
]


def violations(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that are null or repeat, with how often."""
    missing = reduce(Column.__or__, [F.col(k).isNull() for k in key])
    return df.groupBy(*key).agg(F.count("*").alias("n")).where(missing | (F.col("n") > 1))


def migrate(tables: dict[str, DataFrame], applied: list[str], steps=None) -> tuple[dict[str, DataFrame], list[str]]:
    """Apply the steps that are not yet applied, in order; an unknown applied step means a newer store."""
    steps = MIGRATIONS if steps is None else steps
    names = [n for n, _ in steps]
    unknown = [n for n in applied if n not in names]
    if unknown:
        raise ValueError(f"written by a newer version: {unknown}")
    for name, step in steps:
        if name not in applied:
            tables, applied = step(tables), [*applied, name]
    return tables, applied
