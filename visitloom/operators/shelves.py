"""Browsing a catalogue: kinds of looks, sets nearly open to all, searches over sets, and their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.operators.search import matches, with_marks

ANY = 0xFFFF
# How looks are drawn and filed.
HELD_IN_HAND = (11, 12, 13, 14)
WEAPON_CLASS = 2
ARMOUR_CLASS = 4
NEAR_MISS = 2


@dataclass(frozen=True)
class Kind:
    """A kind of look: how it is drawn, and which class and subclass it is filed under."""

    display_types: tuple[int, ...]
    class_id: int | None = None
    subclass_id: int | None = None


SHIELD = Kind(HELD_IN_HAND, ARMOUR_CLASS, 6)
OFF_HAND = Kind(HELD_IN_HAND, ARMOUR_CLASS, 0)


def is_kind(kind: Kind, display_type: Column, class_id: Column, subclass_id: Column) -> Column:
    out = display_type.isin(*kind.display_types)
    if kind.class_id is not None:
        out = out & F.coalesce(class_id == kind.class_id, F.lit(False))
    if kind.subclass_id is not None:
        out = out & F.coalesce(subclass_id == kind.subclass_id, F.lit(False))
    return out


def shelf(sets: DataFrame, openness: DataFrame, exact: Column, most: int = NEAR_MISS) -> DataFrame:
    """Sets of their own look that one or two slots keep from being open to all, nearest first.

    ``sets`` has set_id, folded and ord; ``openness`` has set_id, open_slots and the list blocked;
    ``exact`` says of a blocked ``slot`` whether it can be answered exactly. The order is fewest
    blocked, then any exact, then the sets' own.
    """
    told = sets.where(~F.col("folded")).join(openness, "set_id")
    told = told.where(F.size("blocked").between(1, most) & (F.col("open_slots") > 0))
    slots = told.select("set_id", F.explode("blocked").alias("slot")).groupBy("set_id").agg(F.bool_or(exact).alias("any_exact"))
    return told.join(slots, "set_id").orderBy(F.size("blocked"), F.col("any_exact").desc(), "ord", "set_id")


def said_by(fields: list[Column]) -> Column:
    """What a row says to a search by words: its fields in one text, nulls saying nothing."""
    return F.concat_ws(" ", *fields)


def search_words(rows: DataFrame, search: str, fields: list[Column]) -> DataFrame:
    """Rows that say every word of the search somewhere; words only, so a colon is part of a word."""
    words = search.strip().lower().split()
    said = F.lower(said_by(fields))
    for w in words:
        rows = rows.where(F.contains(said, F.lit(w)))
    return rows


def search_families(
    families: DataFrame, members: DataFrame, search: str, said: Column, facets: Column, marks: DataFrame | None = None, favourite: bool | None = None, tag: str | None = None
) -> DataFrame:
    """Families of which some member or folded set answers; marks are read on members alone.

    ``members`` has family, set_id and folded; ``said`` and ``facets`` are columns of it. Every
    word and term may be answered by another member, so they are gathered by the family first.
    """
    out = families
    if marks is not None and (favourite or tag):
        own = members.where(~F.col("folded")).select("family", "set_id")
        out = out.join(with_marks(own, marks, "set_id", favourite, tag).select("family").distinct(), "family", "left_semi")
    if not search.strip():
        return out
    # a family has few members; their facets are the family's
    whole = members.groupBy("family").agg(F.array_join(F.collect_list(said), " ").alias("_said"), F.flatten(F.collect_list(facets)).alias("_facets"))
    found = whole.where(matches(search, F.col("_said"), F.col("_facets"))).select("family")
    return out.join(found, "family", "left_semi")


def openings(set_looks: DataFrame, reached: DataFrame) -> DataFrame:
    """Each look of each set: (set_id, look, state, item) with state open, blocked or withheld.

    ``set_looks`` has set_id and look; ``reached`` has look, item, name and mask, the mask null or 0
    where nothing is known of an item. An open look names its item: named before unnamed, then the
    smallest id.
    """
    known = F.nullif(F.col("mask"), F.lit(0))
    order = F.struct((F.coalesce("name", F.lit("")) == "").alias("unnamed"), F.col("item").alias("id"))
    looks = reached.where(F.coalesce("item", F.lit(0)) != 0).groupBy("look").agg(
        F.bool_or(known == ANY).alias("_open"), F.count(known).alias("_known"), F.min_by("item", F.when(known == ANY, order)).alias("_item")
    )
    told = set_looks.select("set_id", "look").distinct().join(looks, "look", "left")
    is_open = F.coalesce("_open", F.lit(False))
    state = F.when(is_open, "open").when(F.coalesce("_known", F.lit(0)) > 0, "blocked").otherwise("withheld")
    return told.select("set_id", "look", state.alias("state"), F.when(is_open, F.col("_item")).alias("item"))


def opening_counts(opened: DataFrame) -> DataFrame:
    """How many looks of each set are open, blocked and withheld."""
    return opened.groupBy("set_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("open", "blocked", "withheld")])


def catalogue_list(rows: DataFrame, name: str, declared: int | None = None) -> DataFrame:
    """Rows with a name, each with how many the catalogue declares but withholds.

    Without ``declared`` the rows given are all that it declares.
    """
    named = rows.where(F.coalesce(F.col(name), F.lit("")) != "")
    every = F.lit(declared) if declared is not None else F.col("_all")
    counts = rows.agg(F.count("*").alias("_all"), F.count_if(F.coalesce(F.col(name), F.lit("")) != "").alias("_named"))
    told = named.crossJoin(F.broadcast(counts))  # one row
    return told.withColumn("withheld", F.greatest(every - F.col("_named"), F.lit(0)).cast("long")).drop("_all", "_named")


def collections_approx(held: DataFrame, by: list[str], key: str, error: float = 0.02) -> DataFrame:
    """Approximate number of distinct things held in each group, from a mergeable sketch."""
    return held.groupBy(*by).agg(F.approx_count_distinct(key, error).alias("n_approx"))


def sort_lockouts(rows: DataFrame, key: str = "character", ascending: bool = True) -> DataFrame:
    """By character or by activity, the other and the difficulty after it; the earliest expiry breaks ties."""
    fields = ["activity", "character", "difficulty"] if key == "activity" else ["character", "activity", "difficulty"]
    order = [F.coalesce(F.col(f), F.lit("")) for f in fields]
    return rows.orderBy(*[c.asc() if ascending else c.desc() for c in order], F.col("expiry").asc())


def lockout_texts(rows: DataFrame, now: int) -> DataFrame:
    """Lockouts with expired, a label of their period and a sentence of their bosses (list ``encounters``)."""
    killed = F.size(F.filter("encounters", lambda e: e["killed"]))
    n = F.coalesce(F.size("encounters"), F.lit(0))
    told = F.when(n > 0, F.format_string("%d/%d bosses defeated", killed, n)).when(F.col("kind") == "world_boss", "Defeated").otherwise("No boss data")
    period = F.when(F.col("period") == "daily", "Daily").when(F.col("period") == "weekly", "Weekly").otherwise("—")
    return rows.withColumns({"expired": F.col("expiry") <= now, "period_label": period, "bosses": told})
