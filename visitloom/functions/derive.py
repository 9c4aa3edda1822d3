"""Derived facts and texts: what a lockout is, how far a standing is, what a game text says."""

from __future__ import annotations

import re
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the ids that records carry.
DIFFICULTIES = {1: "Normal", 2: "Heroic", 8: "Mythic Keystone", 14: "Normal", 15: "Heroic", 16: "Mythic", 17: "Looking For Raid", 23: "Mythic", 24: "Timewalking", 33: "Timewalking", 208: "Delves"}
CLASSES = ("Warrior", "Paladin", "Hunter", "Rogue", "Priest", "Death Knight", "Shaman", "Mage", "Warlock", "Monk", "Druid", "Demon Hunter", "Evoker")
QUALITIES = ("Poor", "Common", "Uncommon", "Rare", "Epic", "Legendary", "Artifact", "Heirloom")


def named(number: Column, names: dict[int, str] | tuple[str, ...]) -> Column:
    """The name of a number in a fixed dictionary; null where it has none."""
    pairs = names.items() if isinstance(names, dict) else enumerate(names)
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.try_element_at(table, number.cast("int"))


def lockout_kind(kind: Column, fallback_kind: Column, is_raid: Column, fallback_is_raid: Column) -> Column:
    """raid, dungeon or world_boss: as recorded, else by whether either record calls it a raid."""
    told = F.coalesce(kind, fallback_kind)
    raid = F.coalesce(is_raid, fallback_is_raid, F.lit(False))
    return F.when(told.isin("raid", "dungeon", "world_boss"), told).otherwise(F.when(raid, "raid").otherwise("dungeon"))


def lockout_period(period: Column, kind: Column) -> Column:
    """daily or weekly as recorded, else by the kind; kinds without a rule are unknown."""
    by_kind = F.when(kind == "dungeon", "daily").when(kind.isin("raid", "world_boss"), "weekly").otherwise("unknown")
    return F.when(period.isin("daily", "weekly"), period).otherwise(by_kind)


def faction_standing(reaction_label: Column, renown: Column, paragon: Column, friendship: Column, faction: Column) -> Column:
    """One bar (standing, current, max, rank, system) out of four nullable structs.

    Renown speaks before paragon, paragon before friendship, friendship before the reaction
    ladder. A track without a next step is full: 1 of 1. The bar is clamped to its ends; a bar
    without name and extent is null.
    """

    def bar(label: Column, current: Column, most: Column, rank: Column, system: str) -> Column:
        top = F.greatest(F.floor(F.coalesce(most, F.lit(0))), F.lit(0)).cast("long")
        at = F.least(F.greatest(F.floor(F.coalesce(current, F.lit(0))), F.lit(0)).cast("long"), top)
        told = F.struct(
            label.alias("standing"), at.alias("current"), top.alias("max"), F.floor(rank).cast("long").alias("rank"), F.when(rank.isNotNull(), system).alias("system")
        )
        return F.when(label.isNotNull() | (top > 0), told)

    def track(label: Column, value: Column, floor: Column, ceiling: Column, rank: Column, system: str) -> Column:
        low, high = F.coalesce(floor, F.lit(0)), ceiling
        ended = F.coalesce(high <= low, F.lit(True))
        return bar(label, F.when(ended, 1).otherwise(F.coalesce(value, F.lit(0)) - low), F.when(ended, 1).otherwise(high - low), rank, system)

    threshold = F.coalesce(paragon["threshold"], F.lit(0))
    return (
        F.when(renown["level"].isNotNull(), bar(F.concat(F.lit("Renown "), renown["level"].cast("string")), renown["earned"], renown["threshold"], renown["level"], "renown"))
        .when(threshold > 0, bar(F.lit("Paragon"), F.pmod(F.coalesce(paragon["value"], F.lit(0)), F.nullif(threshold, F.lit(0))), threshold, F.coalesce(faction["reaction"], F.lit(8)), "paragon"))
        .when(F.coalesce(friendship["id"], F.lit(0)) > 0, track(friendship["reaction"], friendship["standing"], friendship["floor"], friendship["ceiling"], friendship["standing"], "friendship"))
        .when(faction.isNotNull(), track(reaction_label, faction["standing"], faction["floor"], faction["ceiling"], faction["reaction"], "reaction"))
    )


def install_status(requested: Column, advanced: Column, growing: Column) -> Column:
    """off, basic, advanced or stale: what was asked, what is set, and whether a log grows."""
    return F.when(~requested, "off").when(~F.coalesce(advanced, F.lit(False)), "basic").when(F.coalesce(growing, F.lit(False)), "advanced").otherwise("stale")


def collected_note(walked: Column, held: Column, counted: Column) -> Column:
    """unwalked, or how many more the client counts than are held; null when there is nothing to say."""
    more = counted - held
    return F.when(~walked, "unwalked").when(more > 0, F.concat(more.cast("string"), F.lit(" more counted")))


def reading_evidence(held: Column, revision: Column, counted: Column) -> Column:
    """Lines that say what a reading wrote down, and what the client counted if it differs."""
    first = F.format_string("%d held at revision %d", held, revision)
    second = F.when(counted != held, F.format_string("%d counted", counted))
    return F.when(held.isNotNull(), F.array_compact(F.array(first, second))).otherwise(F.array().cast("array<string>"))


def age(seconds: Column) -> Column:
    """``now``, ``5m ago``, ``3h ago`` or ``2d ago``; null and negative ages are now."""
    s = F.greatest(F.floor(F.coalesce(seconds, F.lit(0))), F.lit(0)).cast("long")
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(f"{name} ago"))
    return F.when(s < 60, "now").when(s < 3600, unit(60, "m")).when(s < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def ago_in_words(at: Column, now: int) -> Column:
    """``just now``, ``a minute ago``, ``5 minutes ago``, ``an hour ago``, ``yesterday``, ``3 days ago``."""
    s = F.greatest(F.round(F.lit(now) - at), F.lit(0))
    m, h, d = (F.floor(s / n).cast("long") for n in (60, 3600, 86_400))
    many = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name} ago"))
    return (
        F.when(s < 45, "just now").when(m < 2, "a minute ago").when(m < 60, many(m, "minutes"))
        .when(h < 24, F.when(h == 1, "an hour ago").otherwise(many(h, "hours"))).otherwise(F.when(d == 1, "yesterday").otherwise(many(d, "days")))
    )


def day_label(day: Column, today: str) -> Column:
    """Today, Yesterday, ``Tue, 3 Mar``, and the year with it if it is another; other texts stay."""
    date, now = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"), F.to_date(F.lit(today))
    gone = F.datediff(now, date)
    shown = F.when(F.year(date) == F.year(now), F.date_format(date, "EEE, d MMM")).otherwise(F.date_format(date, "EEE, d MMM yyyy"))
    return F.when(date.isNull(), F.coalesce(day, F.lit(""))).when(gone == 0, "Today").when(gone == 1, "Yesterday").otherwise(shown)


# Fixed value: the escapes of game texts. Links keep their words, colours and pictures go, and
# so does a bar that opens nothing.
ESCAPES = r"(?s)\|H.*?\|h(.*?)\|h|\|c[0-9a-fA-F]{8}|\|T.*?\|t|\|A.*?\|a|\|"


def without_escapes(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPES, "$1")


def plain(text: Column) -> Column:
    """A source line as one sentence a part: breaks end sentences, escapes are taken out."""
    broken = without_escapes(F.replace(F.replace(text, F.lit("|n"), F.lit("\n")), F.lit("|r"), F.lit("")))
    parts = F.transform(F.split(broken, "\r?\n"), lambda p: F.regexp_replace(F.trim(p), "[. ]+$", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), ". ")


def message_pattern(template: str) -> tuple[str, list[str]]:
    """Anchored pattern of a ``%s`` and ``%d`` template, and the kind of each group."""
    pattern, kinds = "", []
    for piece in re.findall(r"%.|[^%]+|%$", template, re.S):
        if piece in ("%s", "%d"):
            kinds.append("text" if piece == "%s" else "number")
            pattern += "(.*?)" if piece == "%s" else r"(\d+)"
        else:
            pattern += re.escape(piece[1:] if len(piece) == 2 and piece[0] == "%" else piece)
    return f"(?s)^{pattern}$", kinds


def parse_message(message: Column, templates: list[str]) -> Column:
    """(text, amount) by the first template that fits: its last text and its last number."""

    def one(template: str) -> Column:
        pattern, kinds = message_pattern(template)
        group = lambda kind: [F.regexp_extract(message, pattern, i) for i, k in enumerate(kinds, 1) if k == kind]
        last = lambda found, none: found[-1] if found else none
        text = last(group("text"), F.lit(None).cast("string"))
        amount = last(group("number"), F.lit(None).cast("string")).try_cast("long")
        return F.when(message.rlike(pattern), F.struct(text.alias("text"), amount.alias("amount")))

    return F.coalesce(*[one(t) for t in templates])


def points_of(stored: Column) -> Column:
    """Points of an achievement: the low byte of what is stored."""
    return stored.bitwiseAND(0xFF)


def slots_in_order(slots: Column) -> Column:
    """Structs with a ``slot``, those without dropped, in order, the first of each slot."""
    known = F.filter(slots, lambda s: s["slot"].isNotNull())
    numbered = F.transform(known, lambda s, i: F.struct(s["slot"].alias("slot"), i.alias("i"), s.alias("held")))
    ordered = F.array_sort(numbered)
    firsts = F.filter(ordered, lambda x, i: (i == 0) | (x["slot"] != F.get(ordered, i - 1)["slot"]))
    return F.transform(firsts, lambda x: x["held"])


def experience_step(level: Column, xp: Column, most: Column, last_level: Column, last_xp: Column, last_most: Column) -> tuple[Column, Column]:
    """Points and share of levels gained since the last reading.

    The first reading is a baseline. Levels skipped between two readings count as the new
    level's extent; a loss of level or points counts nothing.
    """
    zero = F.lit(0)
    xp, most, last_xp, last_most = (F.coalesce(c, zero) for c in (xp, most, last_xp, last_most))
    rest = F.greatest(last_most - last_xp, zero)
    between = level - last_level - 1
    same = level == last_level
    gained = F.when(same, xp - last_xp).when(level > last_level, rest + between * most + xp).otherwise(zero)
    share = lambda part, whole: F.when(whole > 0, part / F.nullif(whole, zero)).otherwise(0.0)
    percent = F.when(same, share(xp - last_xp, last_most)).when(level > last_level, share(rest, last_most) + between + share(xp, most)).otherwise(0.0)
    counts = F.coalesce(gained > 0, F.lit(False))
    return F.when(counts, gained).otherwise(zero).cast("long"), F.when(counts, percent).otherwise(0.0)


def content_name(content: Column) -> tuple[Column, Column]:
    """Folder and name under which a content is kept once: its SHA-256, dealt by the first byte."""
    digest = F.sha2(content, 256)
    return F.substring(digest, 1, 2), digest


def copied(events: Column, spec: list) -> Column:
    """A list of structs with the named fields only, nested lists by specs of their own.

    ``spec`` lists names, and pairs (name, spec) for the lists within; what is null stays null.
    """
    return F.transform(events, lambda e: F.struct(*_fields(e, spec)))


def _fields(of: Column, spec: list) -> list[Column]:
    out = []
    for f in spec:
        if isinstance(f, str):
            out.append(of[f].alias(f))
        else:
            out.append(copied(of[f[0]], f[1]).alias(f[0]))
    return out
