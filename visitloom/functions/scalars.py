"""Column functions for text, time, money, colours and coordinates. All null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_key(key: Column) -> tuple[Column, Column]:
    """``name-realm`` at the first dash; without one the realm is empty."""
    cut = F.instr(key, "-")
    return (
        F.when(cut > 0, F.substring(key, F.lit(1), cut - 1)).otherwise(key),
        F.when(cut > 0, F.substring(key, cut + 1, F.length(key))).otherwise(F.when(key.isNotNull(), "")),
    )


def collapse(text: Column) -> Column:
    """Control characters out, white space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1F\x7F]", ""))


def clean_key(text: Column, most: int = 64) -> Column:
    return F.substring(F.lower(collapse(text)), 1, most)


def clipped(text: Column, most: int = 2000) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def hunt(title: Column) -> tuple[Column, Column]:
    """Name and difficulty of ``Prey: name (difficulty)``; the difficulty may be missing."""
    rest = F.trim(F.regexp_extract(F.trim(title), r"^Prey: (.*)$", 1))
    name = F.trim(F.regexp_extract(rest, r"^(.*)[(]([^(]*)[)]$", 1))
    level = F.trim(F.regexp_extract(rest, r"^(.*)[(]([^(]*)[)]$", 2))
    both = (name != "") & (level != "")
    return F.when(both, name).otherwise(F.nullif(rest, F.lit(""))), F.when(both, level)


def ago(at: Column, now: int) -> Column:
    """How long ago, in the largest whole unit."""
    s = F.greatest(F.lit(now) - at, F.lit(0))
    unit = lambda n, name: F.concat(F.floor(s / n).cast("string"), F.lit(name))
    return F.when(s < 60, F.lit("now")).when(s < 3600, unit(60, "m")).when(s < 86_400, unit(3600, "h")).otherwise(unit(86_400, "d"))


def duration(seconds: Column) -> Column:
    """``1h 2m``, ``2m 3s`` or ``3s``."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(s >= 3600, F.format_string("%dh %dm", h, m)).when(s >= 60, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def gold(copper: Column) -> Column:
    """Signed amount in gold, silver and copper: 100 copper a silver, 100 silver a gold."""
    a = F.abs(copper)
    sign = F.when(copper < 0, "-").otherwise("")
    return F.concat(sign, F.format_string("%dg %ds %dc", F.floor(a / 10_000), F.floor(a % 10_000 / 100), a % 100))


def file_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB")) -> Column:
    """Bytes below 1024, else the size in the first of the units that it does not fill 1024 times, or in the last."""
    told = F.format_string(f"%.1f {units[-1]}", n / 1024 ** len(units))
    for k in range(len(units) - 1, 0, -1):
        told = F.when(n < 1024 ** (k + 1), F.format_string(f"%.1f {units[k - 1]}", n / 1024**k)).otherwise(told)
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(told)


def normalised(world_x: Column, world_y: Column, x0: Column, x1: Column, y0: Column, y1: Column) -> tuple[Column, Column]:
    """World to map coordinates; axes swap, and a map without extent gives null."""
    return F.when(y0 != y1, (y0 - world_y) / (y0 - y1)), F.when(x0 != x1, (x0 - world_x) / (x0 - x1))


def hsl(colour: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and lightness of an ``rrggbb`` text."""
    r, g, b = (F.conv(F.substring(colour, i, 2), 16, 10).cast("double") / 255 for i in (1, 3, 5))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (hi + lo) / 2, hi - lo
    sat = F.when(span == 0, 0.0).otherwise(span / (1 - F.abs(2 * light - 1)))
    hue = F.when(span == 0, 0.0).when(hi == r, 60 * F.pmod((g - b) / span, F.lit(6.0))).when(hi == g, 60 * ((b - r) / span + 2)).otherwise(60 * ((r - g) / span + 4))
    return hue, sat, light


# Upper hue of each named band, in degrees.
HUES = ((15, "red"), (45, "orange"), (70, "yellow"), (165, "green"), (200, "cyan"), (255, "blue"), (290, "purple"), (345, "pink"), (361, "red"))


def colour_name(colour: Column) -> Column:
    """Name of a colour: black, white and grey by lightness and saturation, brown for dark orange."""
    hue, sat, light = hsl(colour)
    name = F.lit("red")
    for top, label in reversed(HUES):
        name = F.when(hue < top, label).otherwise(name)
    warm = hue.between(15, 45) & (light < 0.42)
    return F.when(light < 0.08, "black").when(light > 0.92, "white").when(sat < 0.12, "grey").when(warm, "brown").otherwise(name)


def has_bit(mask: Column, bit: int) -> Column:
    """Whether a class may use something: 0 and 0xFFFF mean everyone."""
    return (mask == 0) | (mask == 0xFFFF) | (mask.bitwiseAND(1 << bit) != 0)


def class_names(mask: Column, names: tuple[str, ...]) -> Column:
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(names)]))


def from_hex(text: Column) -> Column:
    """``0x511`` or ``511`` as a number."""
    return F.conv(F.regexp_replace(F.lower(text), "^0x", ""), 16, 10).cast("long")


def integer_keys(m: Column) -> Column:
    """Keys of a map that are whole numbers, as numbers, in order."""
    numbers = F.transform(F.map_keys(m), lambda k: k.try_cast("long"))
    return F.array_sort(F.array_compact(numbers))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-mm-dd`` of a two-digit year, month and day; null outside the calendar's ranges."""
    good = year.between(0, 99) & month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", year + 2000, month, day))


def percent_gained(before: Column, after: Column, most: Column, levels: Column) -> Column:
    """Share of a level gained between two readings, whole levels counting one each."""
    return F.when(most > 0, (after - before) / most + levels)


def first_known(*choices: Column) -> Column:
    """First choice that is neither null nor ``unknown``."""
    return F.coalesce(*[F.when(c != "unknown", c) for c in choices], F.lit("unknown"))


def level_change(items: Column, before: str, after: str) -> Column:
    """Sum of level changes over an array of structs; null if any level is unknown."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda acc, x: acc + x[after].cast("long") - x[before].cast("long"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))
