"""One visit's events folded into its summary, each kind of event by a rule of its own.

Events carry visit_id, at, seq and kind. Every rule is a grouped aggregate over windows that are
keyed by the visit and the thing counted, so no visit's events are gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.derive import experience_step
from visitloom.operators import scan as S

KEY = "visit_id"


def _ordered(*by: str):
    return W.partitionBy(*by).orderBy("at", "seq")


def money_gained(readings: DataFrame) -> DataFrame:
    """Sum of the rises of a wallet; what is spent is not taken off, and the first reading is the start."""
    rise = F.col("money") - F.lag("money").over(_ordered(KEY))
    told = readings.withColumn("_rise", F.when(rise > 0, rise).otherwise(0))
    return told.groupBy(KEY).agg(F.sum("_rise").alias("money_gained"), F.max_by("money", F.struct("at", "seq")).alias("wallet"))


def loot_value(drops: DataFrame, prices: DataFrame) -> DataFrame:
    """Value and count of what dropped; a price that arrives after the drop counts as well.

    ``drops`` has item and quantity, ``prices`` item and price at some time; an item's first price
    is its price. Unpriced items are counted, and add nothing.
    """
    first = prices.groupBy("item").agg(F.min_by("price", "priced_at").alias("price"))
    both = drops.join(first, "item", "left")
    return both.groupBy(KEY).agg(
        F.coalesce(F.sum(F.col("quantity") * F.col("price")), F.lit(0)).alias("loot_value"), F.sum("quantity").alias("items"),
        F.coalesce(F.sum(F.when(F.col("price").isNull(), F.col("quantity"))), F.lit(0)).alias("unpriced"),
    )


def experience(readings: DataFrame) -> DataFrame:
    """Points and share of levels gained over readings (level, xp, xp_max), with the first and last level."""
    w = _ordered(KEY)
    last = [F.lag(c).over(w) for c in ("level", "xp", "xp_max")]
    points, share = experience_step(F.col("level"), F.col("xp"), F.col("xp_max"), *last)
    told = readings.withColumns({"_p": points, "_s": share})
    place = F.struct("at", "seq")
    return told.groupBy(KEY).agg(
        F.sum("_p").alias("gained"), F.sum("_s").alias("percent"), F.min_by("level", place).alias("start_level"), F.max_by("level", place).alias("end_level")
    )


def run_lifecycle(events: DataFrame, kind: str) -> DataFrame:
    """The last run of a kind in a visit: its start, its end if it came after, and what was said of it.

    Events named ``<kind>_start`` and ``<kind>_end`` with level and success; a second start drops the first.
    """
    starts = events.where(F.col("kind") == f"{kind}_start").groupBy(KEY).agg(F.max(F.struct("at", "seq", "level")).alias("s"))
    ends = events.where(F.col("kind") == f"{kind}_end").select(KEY, F.struct("at", "seq", "success").alias("e"))
    met = starts.join(ends, KEY, "left").where(F.col("e").isNull() | (F.struct("e.at", "e.seq") > F.struct("s.at", "s.seq")))
    first = met.groupBy(KEY).agg(F.min("e").alias("e"))
    return starts.join(first, KEY, "left").select(
        KEY, F.col("s.level").alias("level"), F.col("s.at").alias("started_at"), F.col("e.at").alias("completed_at"),
        F.col("e").isNotNull().alias("completed"), F.coalesce("e.success", F.lit(False)).alias("on_time"), (F.col("e.at") - F.col("s.at")).alias("seconds"),
    )


def _place():
    return F.struct("at", "seq")


def _last_known(column: str, where=None):
    """The latest value that is not null, of the rows that ``where`` admits."""
    good = F.col(column).isNotNull() if where is None else F.col(column).isNotNull() & where
    return F.max_by(column, F.when(good, _place()))


def reputation(gains: DataFrame) -> DataFrame:
    """What each faction gave in a visit, and the last standing that was told: (visit_id, faction, amount, standing).

    ``gains`` has faction, amount and standing; lines without a faction or an amount say nothing. A
    standing that is not told again stays.
    """
    good = gains.where(F.col("faction").isNotNull() & F.col("amount").isNotNull())
    return good.groupBy(KEY, "faction").agg(F.sum("amount").alias("amount"), _last_known("standing").alias("standing"))


def currencies(changes: DataFrame) -> DataFrame:
    """What each currency moved by in a visit: (visit_id, currency, name, amount, total).

    ``changes`` has currency, change, name and total. Spending counts against gains, and a currency that
    nets to nothing is still told. A change of 0 or null is none. The name is the last that was
    said, or the currency's number; the total is the last that was told.
    """
    good = changes.where(F.col("currency").isNotNull() & (F.coalesce("change", F.lit(0)) != 0))
    named = _last_known("name", F.col("name") != "")
    return good.groupBy(KEY, "currency").agg(F.coalesce(named, F.col("currency").cast("string")).alias("name"), F.sum("change").alias("amount"), _last_known("total").alias("total"))


def item_currencies(readings: DataFrame, opening: DataFrame) -> DataFrame:
    """Currencies that are items, out of readings of all that is owned: as ``currencies``, with item for currency.

    ``readings`` has item, total and name, ``opening`` the counts (visit_id, item, held) as a visit began.
    A change is the difference to the reading before, of the first to the opening count; an item
    without one takes its first reading for a start. Items whose count never changed are not told.
    """
    known = readings.where(F.col("item").isNotNull() & F.col("total").isNotNull())
    w = _ordered(KEY, "item")
    lagged = known.withColumn("_lag", F.lag("total").over(w)).join(opening.select(KEY, "item", "held"), [KEY, "item"], "left")
    change = F.col("total") - F.coalesce("_lag", "held", "total")
    return currencies(lagged.select(KEY, "at", "seq", F.col("item").alias("currency"), change.alias("change"), "name", "total")).withColumnRenamed("currency", "item")


def keystone(events: DataFrame) -> DataFrame:
    """A visit's keystone run: (visit_id, level, map, started_at, completed, completed_at, duration_ms, on_time, upgrades).

    ``events`` has kind start, complete or reset, level, map, duration_ms, on_time and upgrades. The last
    start with a level opens the run; without one the first completion does, since it carries its own
    level. Completions after that fill in level and map. The last completion or reset decides: a reset
    takes completion, time and upgrades back.
    """
    start = (F.col("kind") == "start") & F.col("level").isNotNull()
    opened = events.groupBy(KEY).agg(
        F.max(F.when(start, _place())).alias("_start"), F.min(F.when(F.col("kind") == "complete", _place())).alias("_first")
    ).select(KEY, F.coalesce("_start", "_first").alias("_open")).where("_open IS NOT NULL")
    run = events.join(opened, KEY).where((_place() >= F.col("_open")) & (start | F.col("kind").isin("complete", "reset")))
    done = F.col("kind") == "complete"
    closing = F.when(F.col("kind") != "start", _place())
    end = F.struct("at", "duration_ms", F.coalesce("on_time", F.lit(False)).alias("on_time"), "upgrades")
    told = run.groupBy(KEY).agg(
        _last_known("level").alias("level"), _last_known("map").alias("map"), F.first("_open.at").alias("started_at"),
        F.coalesce(F.max_by(done, closing), F.lit(False)).alias("completed"), F.max_by(end, F.when(done, _place())).alias("_end"),
    )
    kept = lambda c: F.when(F.col("completed"), F.col(f"_end.{c}"))
    return told.select(KEY, "level", "map", "started_at", "completed", kept("at").alias("completed_at"), *[kept(c).alias(c) for c in ("duration_ms", "on_time", "upgrades")])


def delve(events: DataFrame) -> DataFrame:
    """A visit's delve run: (visit_id, tier, scenario, started_at, completed, completed_at).

    ``events`` has kind start or complete, tier and scenario. The first start opens the run and dates it; a
    completion never does. What later readings know is filled in; the last completion dates the end.
    """
    opened = events.where("kind = 'start'").groupBy(KEY).agg(F.min(_place()).alias("_open"))
    run = events.where("kind IN ('start', 'complete')").join(opened, KEY).where(_place() >= F.col("_open"))
    ended = F.max(F.when(F.col("kind") == "complete", F.struct("at", "seq")))
    told = run.groupBy(KEY).agg(_last_known("tier").alias("tier"), _last_known("scenario").alias("scenario"), F.first("_open.at").alias("started_at"), ended.alias("_end"))
    return told.select(KEY, "tier", "scenario", "started_at", F.col("_end").isNotNull().alias("completed"), F.col("_end.at").alias("completed_at"))


def equipset_changes(changes: DataFrame) -> DataFrame:
    """Changes of equipment sets that say something, numbered within their visit from 0.

    ``changes`` has set_id, kind and items. A set that came or went is told even when empty; an edit
    without items is none.
    """
    good = F.col("set_id").isNotNull() & F.col("kind").isNotNull() & ~((F.col("kind") == "updated") & (F.coalesce(F.size("items"), F.lit(0)) <= 0))
    return changes.where(good).withColumn("position", F.row_number().over(_ordered(KEY)) - 1)


def collected(events: DataFrame, named: tuple[str, ...], told: tuple[str, ...] = ()) -> DataFrame:
    """What a visit met, one row each, with its position from 0 among the visit's events of that kind.

    Kinds in ``named`` always have a name, at worst their id; kinds in ``told`` have one only if one was
    said. An event without an id is none. Flags and other columns stay as they are: null is "nobody
    asked", which is not "no". Positions come from a prefix scan, so a long visit is not one task.
    """
    kind = F.col("kind")
    good = events.where(F.col("id").isNotNull() & kind.isin(*named, *told))
    name = F.when(kind.isin(*named), F.coalesce("name", F.col("id").cast("string"))).when(F.col("name") != "", F.col("name"))
    by = [KEY, "kind"]
    spanned, most = S.numbered(S.by_density(good.withColumn("name", name), by, "at"))
    place = S.Carry("position", "sum", F.lit(1).cast("long"), upto=False)
    return S.scan(spanned, most, by, ["at", "seq"], [place]).drop("_span", "seq")


def added(events: DataFrame, kinds: dict[str, str], amount: str) -> DataFrame:
    """The sum of an amount by kind, one column a kind; a kind that a visit did not see adds 0."""
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(amount))), F.lit(0)).alias(name) for name, k in kinds.items()]
    return events.groupBy(KEY).agg(*sums)


def has_events(visits: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Visits of which at least one part tells something; a visit in which nothing happened is dropped."""
    told = parts[0].select(KEY)
    for part in parts[1:]:
        told = told.unionByName(part.select(KEY))
    return visits.join(told.distinct(), KEY, "left_semi")


def counted(events: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """How many events of each kind a visit saw, one column a kind, from one pass."""
    return events.groupBy(KEY).agg(*[F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()])


def summary(visits: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Visits with every part that has something to say of them; what none says stays null."""
    out = visits
    for part in parts:
        out = out.join(part, KEY, "left")
    return out


def holdings(readings: DataFrame, owner: str, key: str) -> DataFrame:
    """Each owner's last total of each thing; name and shared flag are the last that were said.

    Readings without key or total, and totals below zero, are no readings.
    """
    place = F.struct("at", "seq")
    told = readings.where(F.col(key).isNotNull() & (F.col("total") >= 0))
    return told.groupBy(owner, key).agg(
        F.max_by("total", place).alias("total"), F.max_by("name", F.when(F.col("name").isNotNull(), place)).alias("name"),
        F.coalesce(F.max_by("shared", F.when(F.col("shared").isNotNull(), place)), F.lit(False)).alias("shared"), F.max("at").alias("at"),
    )


def swept(held: DataFrame, seen: DataFrame, claims: DataFrame, scope: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Mark and sweep after a walk: what is held now, and the claims as they may be believed.

    A walk that says it is complete but saw nothing of its scope is refused: its claim becomes
    incomplete and nothing is swept. Domains marked ``grow_only`` are never swept.
    """
    counts = seen.select(*scope, key).distinct().groupBy(*scope).agg(F.count("*").alias("observed"))
    told = claims.join(counts, scope, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    told = told.withColumn("complete", F.col("complete") & (F.col("observed") > 0))
    sweep = told.where(F.col("complete") & ~F.coalesce("grow_only", F.lit(False))).select(*scope)
    stays = held.select(*scope, key).join(sweep, scope, "left_anti")
    now = stays.unionByName(seen.select(*scope, key)).distinct()
    return now, told


def pending(requests: DataFrame, outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Requests that no outcome has answered; each is carried out once."""
    return requests.join(outcomes.select(key).distinct(), key, "left_anti")


def retained(rows: DataFrame, at: str, now: int, days: int = 7) -> DataFrame:
    """Rows of the last days; a row without a time is kept."""
    return rows.where(F.col(at).isNull() | (F.col(at) >= now - days * 86_400))


# What an event of a kind may trigger, the special name only if the event earns it.
TRIGGERS = {
    "achievement": ("accountFirstAchievement", "achievement"), "levelUp": (None, "levelUp"), "mount": (None, "mount"), "pet": (None, "pet"), "toy": (None, "toy"),
    "keystone": ("keystoneOnTime", "keystone"), "transmog": ("newAppearance", "transmog"),
}


def triggered(events: DataFrame, allowed: list[str]) -> DataFrame:
    """Events that may take a picture: (…, trigger, rank), the special name first if it is earned and allowed.

    ``events`` has kind, special and obscured; nothing is taken while the world is obscured.
    """
    name, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for kind, (special, general) in TRIGGERS.items():
        here, earned = F.col("kind") == kind, F.coalesce("special", F.lit(False))
        if general in allowed:
            name, rank = F.when(here, general).otherwise(name), F.when(here, 1 if special is None else 2).otherwise(rank)
        if special in allowed:
            name, rank = F.when(here & earned, special).otherwise(name), F.when(here & earned, 1).otherwise(rank)
    told = events.where(~F.coalesce("obscured", F.lit(False))).withColumns({"trigger": name, "rank": rank})
    return told.where(F.col("trigger").isNotNull())


def bursts(decisions: DataFrame, by: str = "actor", gap: int = 3) -> DataFrame:
    """Decisions that follow each other within ``gap`` become one: the most special, then the first."""
    w = _ordered(by)
    fresh = F.coalesce(F.col("at") - F.lag("at").over(w) > gap, F.lit(True)).cast("int")
    told = decisions.withColumn("_f", fresh).withColumn("burst", F.sum("_f").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return told.groupBy(by, "burst").agg(
        F.min("at").alias("at"), F.min_by("trigger", F.struct("rank", "at", "seq")).alias("trigger"), F.min_by("seq", F.struct("rank", "at", "seq")).alias("seq"), F.count("*").alias("n")
    )
