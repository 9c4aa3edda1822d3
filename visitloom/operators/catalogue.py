"""Catalogue questions: what is held, what is missing, who can use a set, what looks alike."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.operators import scan as S
from visitloom.scratch import Rounds

ANY = 0xFFFF
SALTS = 64
PARTS = 16
#: Bits of a fingerprint's pieces, and the most of them that a lookup flips.
CHUNK = 16
WIDEST = 2
MOST_COLUMNS = 10_000


def first_few(rows: DataFrame, by: str, order: list[str], value: str, most: int) -> DataFrame:
    """For each group the values of its first ``most`` rows, as (_by, few).

    Rows are ranked within salted parts of a group, then what is left of the parts among itself,
    so no task orders or gathers a whole group.
    """
    left = rows.select(F.col(by).alias("_by"), F.struct(*order).alias("_order"), F.col(value).alias("_value"))
    left = left.withColumn("_salt", F.pmod(F.xxhash64("_order", "_value"), F.lit(SALTS)))
    for keys in (["_by", "_salt"], ["_by"]):
        left = left.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy("_order", "_value"))).where(F.col("_rank") <= most)
    few = F.array_sort(F.collect_list(F.struct("_rank", "_value")))
    return left.groupBy("_by").agg(F.transform(few, lambda x: x["_value"]).alias("few"))


def held_and_missing(catalogue: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """The catalogue with held: whether any held row has its key."""
    have = held.select(key).where(F.col(key).isNotNull()).distinct().withColumn("held", F.lit(True))
    return catalogue.join(have, key, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def by_category(catalogue: DataFrame, held: DataFrame, key: str, category: str, points: str, title: str, worst: int = 5) -> DataFrame:
    """For each category held and total counts and points, and the missing worth most first."""
    told = held_and_missing(catalogue, held, key)
    lost = told.where(~F.col("held")).withColumn("_k", -F.col(points))
    few = first_few(lost, category, ["_k", title, key], key, worst)
    counts = told.groupBy(category).agg(
        F.count_if("held").alias("held"), F.count("*").alias("total"),
        F.coalesce(F.sum(F.when(F.col("held"), F.col(points))), F.lit(0)).alias("held_points"), F.sum(points).alias("total_points"),
    )
    both = counts.join(few, F.col(category).eqNullSafe(F.col("_by")), "left")
    missing = F.coalesce(F.array_join(F.transform("few", lambda x: x.cast("string")), ","), F.lit(""))
    return both.withColumn("missing", missing).drop("_by", "few")


def points_earned(held: DataFrame, catalogue: DataFrame, key: str, worth: str, recorded: str) -> DataFrame:
    """Sum of what held rows are worth: the catalogue's worth, else the recorded one, else 0."""
    both = held.join(catalogue.select(key, worth), key, "left")
    return both.agg(F.sum(F.coalesce(F.col(worth), F.col(recorded), F.lit(0))).alias("points"), F.count("*").alias("n"))


def by_year(rows: DataFrame, year: str = "year") -> DataFrame:
    """Counts a year with the years between first and last that have none."""
    counts = rows.where(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min(year).alias("a"), F.max(year).alias("b")).where("a is not null")
    years = ends.select(F.explode(F.sequence("a", "b")).alias(year))
    return years.join(counts, year, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def carriers(held: DataFrame, catalogue: DataFrame, key: str, earner: str, worth: str) -> DataFrame:
    """Earned rows and points of each earner, most points first."""
    told = held.join(catalogue.select(key, worth), key, "left").groupBy(earner).agg(
        F.count("*").alias("earned"), F.coalesce(F.sum(worth), F.lit(0)).alias("points")
    )
    return told.orderBy(F.col("points").desc(), F.col("earned").desc(), F.col(earner).asc())


def with_child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents with the number of their children, 0 when none."""
    n = children.groupBy(key).agg(F.count("*").alias("n_children"))
    return parents.join(n, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def inverted(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the distinct values that reach it, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("reached_by"))


def chain(start: DataFrame, hops: list[tuple[DataFrame, str, dict[str, object]]]) -> DataFrame:
    """Left joins hop by hop; a hop is (table, key, defaults for what it brings when absent)."""
    out = start
    for side, key, defaults in hops:
        out = out.join(side, key, "left").withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    return out


def first_answer(keys: DataFrame, tiers: list[DataFrame], key: str, answer: str) -> DataFrame:
    """Each key with the answer of the first tier that has one, and that tier's number."""
    out, found, tier_of = keys.select(key).distinct(), [], F.lit(None).cast("int")
    for i, tier in enumerate(tiers):
        out = out.join(tier.groupBy(key).agg(F.min(answer).alias(f"_a{i}")), key, "left")
        found.append(F.col(f"_a{i}"))
    for i in reversed(range(len(tiers))):
        tier_of = F.when(F.col(f"_a{i}").isNotNull(), i).otherwise(tier_of)
    return out.select(key, F.coalesce(*found).alias(answer), tier_of.alias("tier"))


def by_folded_name(wanted: DataFrame, tables: list[DataFrame], name: str, value: str) -> DataFrame:
    """Lookup by trimmed lower-case name in tables of falling priority; zero and null are no answer."""
    fold = F.lower(F.trim(F.col(name)))
    every = None
    for prio, t in enumerate(tables):
        one = t.where((F.col(value) != 0) & F.col(value).isNotNull()).select(fold.alias("_f"), F.lit(prio).alias("_p"), F.col(value).alias("_v"))
        every = one if every is None else every.unionByName(one)
    best = every.groupBy("_f").agg(F.min(F.struct("_p", "_v"))["_v"].alias(value))
    return wanted.withColumn("_f", fold).join(best, "_f", "left").drop("_f")


def grid(rows: DataFrame, columns: DataFrame, states: DataFrame, keys: list[str], default: str = "available") -> DataFrame:
    """Every row with every column and its state, ``default`` where nothing is known.

    The product is what is asked for; ``columns`` (one row an activity) becomes one list, so that
    each row is exploded where it lies and nothing is matched. More than MOST_COLUMNS are refused.
    """
    listed = columns.agg(F.collect_list(F.struct(*columns.columns)).alias("_all"))
    n = columns.limit(MOST_COLUMNS + 1).count()
    if n > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns in a grid")
    every = rows.crossJoin(F.broadcast(listed))  # one row
    every = every.select(*rows.columns, F.explode("_all").alias("_one")).select(*rows.columns, "_one.*")
    return every.join(states.select(*keys, "state"), keys, "left").withColumn("state", F.coalesce("state", F.lit(default)))


def siblings(rows: DataFrame, key: str, shape: str) -> DataFrame:
    """For each key how many others share its shape, and the smallest other."""
    few = first_few(rows.where(F.col(key).isNotNull()).select(shape, key).distinct(), shape, [key], key, 2)
    counts = rows.groupBy(shape).agg(F.count("*").alias("_n"))
    low = counts.join(few, F.col(shape) == F.col("_by"), "left").select(shape, "_n", F.col("few").alias("_low"))
    told = rows.join(low, shape)
    other = F.when(F.get("_low", F.lit(0)) == F.col(key), F.get("_low", F.lit(1))).otherwise(F.get("_low", F.lit(0)))
    return told.select(key, shape, (F.col("_n") - 1).alias("n_siblings"), other.alias("first_sibling"))


def set_wearers(items: DataFrame, set_slots: DataFrame) -> DataFrame:
    """Which classes can wear each set: AND over slots of OR over looks of OR over items.

    ``items`` is (look, mask), mask 0 meaning everyone; ``set_slots`` is (set_id, slot, look).
    """
    mask = F.when(F.col("mask") == 0, ANY).otherwise(F.col("mask"))
    looks = items.groupBy("look").agg(F.bit_or(mask).alias("mask"))
    slots = set_slots.join(looks, "look").groupBy("set_id", "slot").agg(F.bit_or("mask").alias("mask"))
    return slots.groupBy("set_id").agg(F.bit_and("mask").alias("mask"), F.count("*").alias("n_slots"))


def set_openness(items: DataFrame, set_slots: DataFrame) -> DataFrame:
    """Slots of each set that anyone can fill, and the sorted list of those nobody in general can."""
    looks = items.groupBy("look").agg(F.bool_or((F.col("mask") == 0) | (F.col("mask") == ANY)).alias("open"))
    slots = set_slots.join(looks, "look").groupBy("set_id", "slot").agg(F.bool_or("open").alias("open"))
    told = slots.groupBy("set_id").agg(
        F.count_if("open").alias("open_slots"), F.count("*").alias("slots"), F.array_sort(F.collect_list(F.when(~F.col("open"), F.col("slot")))).alias("blocked")
    )
    share = F.col("open_slots") / F.col("slots")
    words = F.when(share == 1, "all").when(share >= 0.75, "most").when(share > 0, "some").otherwise("none")
    return told.withColumn("words", words)


def representative(items: DataFrame, look: str = "look") -> DataFrame:
    """Each look's item: named before unnamed, open before restricted, lowest level, then id."""
    order = F.struct((F.coalesce("name", F.lit("")) == "").alias("a"), (F.col("mask") != 0).alias("b"), "required_level", F.col("item").alias("d"))
    return items.groupBy(look).agg(
        F.min_by("item", order).alias("item"), (F.bool_or(F.col("mask") == 0) & F.bool_or(F.col("mask") != 0)).alias("lifts_restriction")
    )


def near_misses(openness: DataFrame, most: int = 2) -> DataFrame:
    """Sets with one or two blocked slots and something open, least blocked first."""
    blocked = F.size("blocked")
    return openness.where(blocked.between(1, most) & (F.col("open_slots") >= 1)).orderBy(blocked, "set_id")


def fold_equal_sets(sets: DataFrame, members: DataFrame, order: list[str]) -> DataFrame:
    """Sets with the same members fold into the first by ``order``: (set_id, shown_id, folded).

    The members' list is replaced by two independent hashes (a salt first, so that the second
    does not go on from the first) and its length before sets are compared, so the exchange
    carries numbers. Sets without members are never folded.
    """
    listed = members.groupBy("set_id").agg(F.array_sort(F.collect_set("member")).alias("m"))
    marks = listed.select("set_id", F.size("m").alias("_n"), F.xxhash64("m").alias("_h"), F.xxhash64(F.lit(1), "m").alias("_g"))
    told = sets.join(marks, "set_id")
    first = told.groupBy("_n", "_h", "_g").agg(F.min(F.struct(*order, "set_id"))["set_id"].alias("shown_id"))
    out = told.join(first, ["_n", "_h", "_g"])
    return out.select("set_id", "shown_id", (F.col("set_id") != F.col("shown_id")).alias("folded"))


def order_statistics(rows: DataFrame, by: list[str], measure: str, places: dict[str, Column]) -> DataFrame:
    """For each group the values at the given places (from 0) of its sorted, non-null measures.

    Places are columns over ``_n``, the group's number of values. Equal values are counted first, on
    the map side; a prefix scan over the counts finds the value that reaches past a place. No group is
    sorted in one task. Measures are finite numbers.
    """
    counts = rows.where(F.col(measure).isNotNull()).groupBy(*by, measure).agg(F.count("*").alias("_c"))
    whole = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    told, most = S.numbered(S.by_density(counts, by, measure))
    told = S.joined(S.scan(told, most, by, [measure], [S.Carry("_upto", "sum", F.col("_c"))]), whole, by)
    holds = lambda at: (F.col("_upto") - F.col("_c") <= at) & (at < F.col("_upto"))
    return told.groupBy(*by).agg(*[F.max(F.when(holds(at), F.col(measure))).alias(n) for n, at in places.items()], F.max("_n").alias("_n"))


def bands(rows: DataFrame, group: str, measure: str, names: tuple[str, ...] = ("small", "medium", "large")) -> DataFrame:
    """Rows with a band by lower-index quantile cuts of their group.

    The cut at fraction f is sorted[min(int(n * f), n - 1)], an order statistic.
    """
    k = len(names)
    at = {f"_c{i}": F.least((F.col("_n") * i / k).cast("long"), F.col("_n") - 1) for i in range(1, k)}
    cuts = order_statistics(rows.select(group, measure), [group], measure, at).drop("_n")
    band = F.lit(names[-1])
    for i in range(k - 1, 0, -1):
        band = F.when(F.col(measure) < F.col(f"_c{i}"), names[i - 1]).otherwise(band)
    return S.joined(rows, cuts, [group], "left").withColumn("band", F.when(F.col(measure).isNotNull(), band)).drop(*at)


def _apart(words: int) -> Column:
    """Hamming distance of ``_a`` and ``_b``."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.get("_a", F.lit(i)).bitwiseXOR(F.get("_b", F.lit(i)))) for i in range(words)])


def _chunks(bits: str, words: int, word: int) -> Column:
    """The CHUNK-bit pieces of a fingerprint, in order."""
    mask = (1 << CHUNK) - 1
    return F.array(*[F.shiftright(F.get(bits, F.lit(i)), lo).bitwiseAND(mask).cast("int") for i in range(words) for lo in range(0, word, CHUNK)])


def _flips(weight: int) -> list[int]:
    """All CHUNK-bit patterns of so many ones."""
    return [sum(1 << i for i in at) for at in combinations(range(CHUNK), weight)]


def _best(met: DataFrame, k: int, keys: list[str]) -> DataFrame:
    return met.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("distance", "other"))).where(F.col("rank") <= k)


def _nearest_of_all(prints: DataFrame, asked: DataFrame, k: int, words: int) -> DataFrame:
    """(id, other, distance) of the k nearest within the slot; PARTS parts of a slot are ranked first."""
    a = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    b = prints.select("*", F.pmod(F.xxhash64("other"), F.lit(PARTS)).cast("int").alias("_part"))
    met = a.join(b, ["slot", "_part"]).where("id <> other").select("id", "_part", "other", _apart(words).alias("distance"))
    return _best(met, k, ["id", "_part"]).select("id", "other", "distance")


def nearest_by_bits(prints: DataFrame, asked: DataFrame, width: int, k: int = 8, cut: int | None = None, word: int = 32) -> DataFrame:
    """Nearest fingerprints by Hamming distance within a slot: (id, rank, other, distance).

    Fingerprints are arrays of longs with ``word`` bits each, ``width`` in all. Multi-index hashing: a
    print is cut in m pieces of CHUNK bits, and prints that are at most m * (s + 1) - 1 bits apart agree
    in a piece but for s bits. So round s looks up the pieces with s bits flipped, by a join on (slot,
    piece, value), and settles the questions whose k-th find lies within that distance; the rest go on to
    the next round, and after WIDEST to all prints of their slot, in parts. Of equal prints the first
    k + 1 by id stand for all, since no more of them can be asked for. Exact; ties go to the smaller id.
    Rows without a slot or a fingerprint take no part.
    """
    if word % CHUNK or width % word:
        raise ValueError(f"width must be a multiple of word, and word of {CHUNK}")
    rounds = Rounds(prints.sparkSession, "prints")
    words, m = width // word, width // CHUNK
    whole = F.col("slot").isNotNull() & F.col("bits").isNotNull()
    b = prints.where(whole).select(F.col("id").alias("other"), "slot", F.col("bits").alias("_b"))
    first = W.partitionBy("slot", "_b").orderBy("other")
    b = rounds.save(b.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k + 1).drop("_r"))
    left = rounds.save(asked.where(whole).select("id", "slot", F.col("bits").alias("_a")))
    pieces = b.select("*", F.posexplode(_chunks("_b", words, word)).alias("_at", "_v"))
    found = settled = None
    for s in range(WIDEST + 1):
        flipped = F.explode(F.array(*[F.lit(x) for x in _flips(s)]))
        probes = left.select("*", F.posexplode(_chunks("_a", words, word)).alias("_at", "_w")).select("*", flipped.alias("_x"))
        probes = probes.select("id", "slot", "_a", "_at", F.col("_w").bitwiseXOR(F.col("_x")).alias("_v"))
        met = probes.join(pieces, ["slot", "_at", "_v"]).where("id <> other").select("id", "other", _apart(words).alias("distance"))
        met = met if found is None else met.unionByName(found.join(left.select("id"), "id", "left_semi"))
        found = rounds.save(_best(met.distinct(), k, ["id"]).drop("rank"))
        sure = m * (s + 1) - 1
        told = found.where(F.col("distance") <= sure).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("id")
        if cut is not None and cut <= sure:
            told = left.select("id")
        done = found.join(told, "id", "left_semi")
        settled = done if settled is None else settled.unionByName(done)
        left = rounds.save(left.join(told, "id", "left_anti"))
        if left.isEmpty():
            break
    met = settled.unionByName(_nearest_of_all(b, left, k, words))
    met = met if cut is None else met.where(F.col("distance") <= cut)
    return _best(met, k, ["id"]).select("id", "rank", "other", "distance")


def sign_bits(vector: Column, width: int, word: int = 62) -> Column:
    """Fingerprint of a vector: the signs of its components, packed in longs."""
    words = []
    for lo in range(0, width, word):
        bits = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << (i - lo)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(lo, min(width, lo + word))]
        words.append(reduce(lambda x, y: x + y, bits))
    return F.array(*words)


def stranger_cut(rows: DataFrame, distance, least: int = 4, share: float = 0.005) -> DataFrame:
    """For each slot the distance below which a share of stranger pairs lies.

    Strangers are each row and the row half the slot further on, in the order of ids: a
    deterministic sample of as many pairs as rows. Fewer than ``least`` pairs give null.
    """
    counts = rows.groupBy("slot").agg(F.count("*").alias("_n"))
    numbered, most = S.numbered(S.by_density(rows, ["slot"], "id"))
    numbered = S.scan(numbered, most, ["slot"], ["id"], [S.Carry("_i", "sum", F.lit(1).cast("long"), upto=False)]).drop("_span")
    numbered = Rounds(rows.sparkSession, "strangers").save(numbered)  # both sides of the join
    numbered = S.joined(numbered, counts, ["slot"])
    other = numbered.select(F.col("slot").alias("_s"), F.col("_i").alias("_j"), F.col("bits").alias("_b"))
    step = F.greatest(F.floor(F.col("_n") / 2), F.lit(1))
    met = numbered.join(other, (F.col("slot") == F.col("_s")) & (F.col("_j") == F.pmod(F.col("_i") + step, F.col("_n"))) & (F.col("_i") != F.col("_j")))
    told = met.select("slot", distance("bits", "_b").alias("d"))
    cut = order_statistics(told, ["slot"], "d", {"cut": F.least((F.col("_n") * share).cast("long"), F.col("_n") - 1)})
    return cut.select("slot", F.when(F.col("_n") >= least, F.col("cut")).alias("cut"), F.col("_n").alias("n_pairs"))


def paths(nodes: DataFrame, depth: int = 8) -> DataFrame:
    """(id, root, path) by walking parents at most ``depth`` times; stops at missing or own parents.

    Rows at their end join by their own id, under a flag that no node bears: by the parent, all that
    ended at one root, or at none, would meet in one task in every round that follows.
    """
    up = nodes.select(F.col("id").alias("_id"), F.col("parent").alias("_p"), F.col("name").alias("_name"), F.lit(True).alias("_on"))
    out = nodes.select("id", F.col("id").alias("root"), F.col("parent").alias("next"), F.array("name").alias("path"))
    for _ in range(depth):
        going = F.coalesce(F.col("next") != F.col("root"), F.lit(False))
        asked = out.withColumns({"_going": going, "_key": F.when(going, F.col("next")).otherwise(F.col("id"))})
        step = asked.join(up, (F.col("_key") == F.col("_id")) & (F.col("_going") == F.col("_on")), "left")
        out = step.select(
            "id", F.coalesce("_id", "root").alias("root"), F.when(F.col("_id").isNotNull(), F.col("_p")).alias("next"),
            F.when(F.col("_id").isNotNull(), F.concat(F.array("_name"), "path")).otherwise(F.col("path")).alias("path"),
        )
    return out.select("id", "root", F.array_join("path", "/").alias("path"))


def unique_roots(leaves: DataFrame, nodes: DataFrame, depth: int = 12) -> DataFrame:
    """Roots that lead to exactly one subject, with the smallest leaf that says so."""
    walked = paths(nodes, depth).select(F.col("id").alias("node"), "root")
    told = leaves.join(walked, "node").groupBy("root").agg(F.countDistinct("subject").alias("n"), F.min("subject").alias("subject"), F.min("leaf").alias("leaf"))
    return told.where("n = 1").select("root", "subject", "leaf")


def fold_families(sets: DataFrame, depth: int = 8) -> DataFrame:
    """Sets of one root and class mask as families: representative is the first drawn."""
    rooted = sets.join(paths(sets.select("id", "parent", "name"), depth).select("id", "root"), "id")
    return rooted.groupBy("root", "mask").agg(F.min(F.struct("ord", "id"))["id"].alias("shown_id"), F.min("ord").alias("ord"), F.count("*").alias("n_sets"))


def group_by_collection(families: DataFrame, collection: str, arrival: str) -> DataFrame:
    """Buckets by collection, else by arrival, in the order of their first family."""
    bucket = F.coalesce(F.nullif(F.trim(F.col(collection)), F.lit("")), F.col(arrival))
    return families.groupBy(bucket.alias("bucket")).agg(F.min("ord").alias("first_ord"), F.count("*").alias("n")).orderBy("first_ord", "bucket")


def colour_buckets(pixels: DataFrame, key: str, apart: int = 96) -> DataFrame:
    """Primary and accent colour of each picture from (key, r, g, b, weight) rows.

    Channels are cut to 4 bits; the primary is the heaviest bucket, ties to the smaller
    colour; the accent is the heaviest one at least ``apart`` from it.
    """
    cell = lambda c: F.shiftright(c, 4) * 17
    heavy = pixels.groupBy(key, cell("r").alias("r"), cell("g").alias("g"), cell("b").alias("b")).agg(F.sum("weight").alias("w"))
    heavy = heavy.withColumn("rgb", F.col("r") * 65536 + F.col("g") * 256 + F.col("b"))
    order = F.struct("w", (-F.col("rgb")).alias("c"))
    first = heavy.groupBy(key).agg(F.max_by(F.struct("r", "g", "b", "rgb"), order).alias("p"))
    told = heavy.join(first, key)
    far = F.abs(F.col("r") - F.col("p.r")) + F.abs(F.col("g") - F.col("p.g")) + F.abs(F.col("b") - F.col("p.b")) >= apart
    return told.groupBy(key).agg(F.first("p.rgb").alias("primary_rgb"), F.max_by(F.when(far, F.col("rgb")), F.when(far, order)).alias("accent_rgb"))
