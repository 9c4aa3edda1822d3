"""MinHash near-duplicate groups by tensored banding, verified on full shingle sets.

Two collections of ``COLLECTIONS`` small groups of ``HALF`` minhashes each are computed, 48
hash functions in all. The key of table (i, j) joins group i of the first collection with
group j of the second, so 144 tables of four minhashes come from 48 hash evaluations instead
of 576. Two texts meet in some table iff a group of either collection agrees, which at a
similarity of exactly 0.75 fails with probability 2 * (1 - 0.75**2)**12 = 1e-4, and ever less
above. The tables are evaluated lazily: second keys are only formed for texts whose first key
someone shares.

Texts with equal sets are one class and enter once, so groups of copies cost nothing. Every
bucket first proposes its smallest member against the others; verified links are joined into
components. Where texts of different components still meet, blocks of bounded size compare
them by their sketches and sizes, and what remains possible is counted on full sets in the same
blocks. A first key that more than a block of open texts share is dealt by the full table keys
instead, where that takes fewer rows, so that a hot half of a key makes no block pairs of its own. No pair of different
components that meets in a table is left out; a bucket that is one component costs no pairs,
and two components that are linked once are not compared further.

Texts are fetched by a side that is broadcast within a checked size and else by a shuffled hash
join; other broadcasts are left to Spark, which knows the sizes of the tables saved here. Tables
are saved before joins by a key that may be hot, so that adaptive execution can split them.

Defined results: null texts and texts without words are linked with nothing; rows without
doc_id are linked with nothing, kept, and have a null component; rows that repeat a doc_id with
the same text are one document; with different texts each row is judged by its own text, under
the smallest doc_id that its text reaches; ties need no rule, since links are exact; a very
long text is hashed whole, in memory proportional to its length; other columns are not read,
so names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import Scratch, aside, small_side
from visitloom.llm.components import components
from visitloom.llm.shingles import chunks, mix, shingle_sets
from visitloom.session import ship

COLLECTIONS = 12
HALF = 2
HASHES = 2 * COLLECTIONS * HALF
#: Of 48 minhashes so many agree at a similarity of 0.75 but for a probability of 1e-5.
AGREE = 22
BLOCK = 256
NUM, DEN = 75, 100

_MULT = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64)) | np.uint64(1)
_PLUS = mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64))


def _profiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            n = len(part)
            doc, s = shingle_sets(part.column(1), k)
            size = np.bincount(doc, minlength=n).astype(np.int64)
            some = np.flatnonzero(size)
            f1, f2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
            sketch = np.zeros((n, HASHES), np.uint32)
            if len(some):
                first = np.searchsorted(doc, some)
                f1[some] = np.add.reduceat(s, first).view(np.int64)
                f2[some] = np.bitwise_xor.reduceat(mix(s + np.uint64(77)), first).view(np.int64)
                for i in range(HASHES):
                    low = np.minimum.reduceat((s * _MULT[i] + _PLUS[i]) >> np.uint64(32), first)
                    sketch[some, i] = low.astype(np.uint32)
            flat = sketch.tobytes()
            width = 4 * HASHES
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(size), pa.array(f1), pa.array(f2), pa.array([flat[i * width : (i + 1) * width] for i in range(n)], pa.binary())],
                ["doc_id", "text_key", "n", "f1", "f2", "sketch"],
            )


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            doc, s = shingle_sets(part.column(1), k)
            offsets = np.searchsorted(doc, np.arange(len(part) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(s.view(np.int64)))], ["rep", "set"]
            )


def _group_key(collection: int, i: int) -> Column:
    at = 4 * HALF * (collection * COLLECTIONS + i) + 1
    return F.substring("sketch", at, 4 * HALF)


def _second_keys() -> Column:
    """The full keys of all tables that begin with the first key, one for each j."""
    return F.array(*[F.xxhash64(F.col("first"), F.lit(j), _group_key(1, j)) for j in range(COLLECTIONS)])


def _sizes_allow(na: Column, nb: Column) -> Column:
    """Sizes alone allow the similarity."""
    return F.least(na, nb) * DEN >= F.greatest(na, nb) * NUM


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"))
    told = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return told.where(F.col("both") * DEN >= (F.size("sa") + F.size("sb") - F.col("both")) * NUM).select("a", "b")


def _candidate_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(rep, set): full sets of the texts at (doc_id, text_key)."""
    texts = docs.join(small_side(wanted, 48), ["doc_id", "text_key"]).select("rep", "text")
    return texts.mapInArrow(lambda it: _sets(it, k), "rep long, set array<long>")


def _several(members: DataFrame, key: str) -> DataFrame:
    """Buckets that hold several components, with their sizes; buckets of two were tried in the first round."""
    sized = members.groupBy(key).agg(F.count("*").alias("members"), F.min("label").alias("l0"), F.max("label").alias("l1"))
    return sized.where("l0 <> l1 and members > 2").select(key, "members")


def _dealt(live: DataFrame, labels: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members of buckets with several components, in pairs of blocks (x, y) that bound a task's work.

    A bucket is a first key. One with more than BLOCK members is dealt by its full keys, one for
    each ``j``, instead, if the full keys that hold several components take fewer rows than the
    pairs of blocks of the first key would; where none does, nothing is left to compare.
    """
    named = live.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.save(named.select("first", "i", "rep", F.coalesce("label", "rep").alias("label")), "named")
    sized = scratch.save(_several(named, "first"), "sized")
    still = scratch.save(named.join(sized, "first"), "open")
    hot = still.where(F.col("members") > BLOCK).join(classes.select("rep", "sketch"), "rep")
    hot = scratch.save(hot.select("first", "i", "rep", "label", F.col("members").alias("all"), F.posexplode(_second_keys()).alias("j", "key")), "hot")
    crowded = scratch.save(_several(hot, "key"), "crowded")
    full = scratch.save(hot.join(crowded, "key"), "full")
    rows = lambda m: F.col(m) * F.ceil(F.col(m) / BLOCK)
    dear = full.groupBy("first", "all").agg(F.sum(F.ceil(F.col("members") / BLOCK)).alias("rows")).where(F.col("rows") >= rows("all"))
    dear = scratch.save(dear.select("first"), "dear")
    by_first = still.where(F.col("members") <= BLOCK).unionByName(still.where(F.col("members") > BLOCK).join(dear, "first", "left_semi"))
    by_first = by_first.select(F.col("first").alias("key"), F.lit(-1).alias("j"), "i", "rep", "label", "members")
    by_full = full.join(dear, "first", "left_anti").select("key", "j", "i", "rep", "label", "members")
    dealt = scratch.save(by_first.unionByName(by_full), "dealt").join(classes.select("rep", "n", "sketch"), "rep")
    dealt = dealt.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "i", "j", "block", "rep", "label", "n", "sketch")


def _together(df: DataFrame) -> DataFrame:
    """Rows of a group (key, x, y) one after another in one partition."""
    return df.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "rep")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of sorted batches; only a group cut by the end of a batch is held over."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "x", "y")])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            key = tuple(keys[lo])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _numbers(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy()


def _possible(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left block, of the right block, and which of their pairs may still be links.

    Those of different components that meet in a table of this bucket's first key (in table
    ``j`` if the bucket is a full key), and in no earlier table (so each pair comes up once),
    and that sketches and sizes leave possible.
    """
    x, y, i, j = (group.column(c)[0].as_py() for c in ("x", "y", "i", "j"))
    block, n, label = _numbers(group, "block"), _numbers(group, "n"), _numbers(group, "label")
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint32).reshape(len(group), HASHES)
    equal = sketch[left][:, None, :] == sketch[right][None, :, :]
    whole = equal.reshape(len(left), len(right), 2 * COLLECTIONS, HALF).all(axis=3)
    second = whole[:, :, COLLECTIONS:]
    met = second.any(axis=2) if j < 0 else second[:, :, j] & ~second[:, :, :j].any(axis=2)
    good = met & ~whole[:, :, :i].any(axis=2) & (equal.sum(axis=2) >= AGREE)
    low, high = np.minimum(n[left][:, None], n[right]), np.maximum(n[left][:, None], n[right])
    good &= (low * DEN >= high * NUM) & (label[left][:, None] != label[right])
    return left, right, np.triu(good, 1) if x == y else good


_ASKED = pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("rep", pa.int64()), ("label", pa.int64()), ("partners", pa.list_(pa.int64()))])


def _open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of two blocks that have possible pairs, the left ones with their partners."""
    out: list[tuple] = []
    for group in _groups(batches):
        left, right, good = _possible(group)
        if good.any():
            rep, label = _numbers(group, "rep"), _numbers(group, "label")
            key = tuple(group.column(c)[0].as_py() for c in ("key", "x", "y"))
            asks = {left[k]: rep[right[good[k]]] for k in np.flatnonzero(good.any(axis=1))}
            asks = {k: asks.get(k, []) for k in dict.fromkeys([*asks, *right[good.any(axis=0)]])}
            out += [(*key, rep[k], label[k], v) for k, v in asks.items()]
        if len(out) >= 2_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ASKED.types, strict=True)], schema=_ASKED)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ASKED.types, strict=True)], schema=_ASKED)


def _confirmed(group: pa.Table) -> list[tuple[int, int]]:
    """Links among the pairs of two blocks, counted on full sets; one for two components is enough."""
    rep, label = _numbers(group, "rep").tolist(), _numbers(group, "label").tolist()
    # sets are sorted as the unsigned hashes that they are
    sets = {r: v.values.to_numpy().view(np.uint64) for r, v in zip(rep, group.column("set"), strict=True)}
    of = dict(zip(rep, label, strict=True))
    out, linked = [], set()
    for a, partners in zip(rep, group.column("partners").to_pylist(), strict=True):
        todo = [b for b in partners if (of[a], of[b]) not in linked]
        if not todo:
            continue
        mine, theirs = sets[a], [sets[b] for b in todo]
        size = np.array([len(t) for t in theirs])
        flat = np.concatenate(theirs)
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.cumsum(size) - size)
        for k in np.flatnonzero(both * DEN >= (len(mine) + size - both) * NUM):
            pair = (of[a], of[todo[k]])
            if pair not in linked:
                linked |= {pair, pair[::-1]}
                out.append((min(a, todo[k]), max(a, todo[k])))
    return out


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        if found := _confirmed(group):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])


def _numbered(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """Classes with ``rep``, a number of their own, and whether texts that differ share a doc_id.

    A class is known by its smallest doc_id, so that the first document of a bucket is the one that
    the others are compared with; where several classes have the same, one keeps it and the others
    get numbers that are no doc_id.
    """
    twice = classes.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("text_key").alias("keeps")).where("c > 1")
    twice = scratch.save(twice.select(F.col("doc_id").alias("twice"), "keeps"), "twice")
    if not twice.limit(1).count():
        return classes.withColumn("rep", F.col("doc_id")), False
    ends = classes.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    free = F.monotonically_increasing_id()
    free = F.lit(ends["hi"] + 1) + free if ends["hi"] < 1 << 61 else F.lit(ends["lo"] - 1) - free
    told = classes.join(twice, classes["doc_id"] == twice["twice"], "left")
    keeps = F.col("twice").isNull() | (F.col("text_key") == F.col("keeps"))
    return scratch.save(told.select(F.when(keeps, F.col("doc_id")).otherwise(free).alias("rep"), *classes.columns), "classes"), True


def _judged(documents: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_key, n, component_id) of each row."""
    ship(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    profiles = scratch.save(
        docs.mapInArrow(lambda it: _profiles(it, k), "doc_id long, text_key long, n long, f1 long, f2 long, sketch binary"), "profiles"
    )
    told = profiles.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = told.groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("sketch").alias("sketch"))
    classes, shared_ids = _numbered(scratch.save(classes.select("at.*", "n", "f1", "f2", "sketch"), "found"), scratch)

    # the tables: (key, rep), for texts that share a first key with another text
    firsts = F.array(*[F.xxhash64(F.lit(i), _group_key(0, i)) for i in range(COLLECTIONS)])
    first = classes.select("rep", F.posexplode(firsts).alias("i", "first"))
    shared = scratch.save(first.groupBy("first").agg(F.count("*").alias("c")).where("c > 1").select("first"), "shared")
    live = scratch.save(first.join(shared, "first", "left_semi"), "live")
    table = live.join(classes.select("rep", "sketch"), "rep").select("rep", F.explode(_second_keys()).alias("key"))
    table = scratch.save(table, "table")
    buckets = scratch.save(
        table.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("c")).where("c > 1").select("key", "least"), "buckets"
    )

    # every bucket's smallest member against the others
    sizes = classes.select("rep", "n")
    met = table.join(buckets, "key").select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()
    met = scratch.save(met, "met")
    stars = met.where("a <> b").join(sizes.select(F.col("rep").alias("a"), F.col("n").alias("na")), "a")
    stars = stars.join(sizes.select(F.col("rep").alias("b"), F.col("n").alias("nb")), "b")
    stars = scratch.save(stars.where(_sizes_allow(F.col("na"), F.col("nb"))).select("a", "b"), "stars")
    wanted = met.select(F.col("b").alias("rep")).distinct().join(classes.select("rep", "doc_id", "text_key"), "rep")
    sets = scratch.save(_candidate_sets(docs, scratch.save(wanted, "wanted"), k), "sets")
    scratch.drop("shared", "table", "buckets", "met", "wanted")
    links = scratch.save(_verified(stars, sets), "links-1")
    labels = scratch.save(components(links, scratch, "first"), "labels-1")

    # buckets that still hold several components
    asked = _together(_dealt(live, labels, classes, scratch)).mapInArrow(
        _open_members, "key long, x int, y int, rep long, label long, partners array<long>"
    )
    asked = scratch.save(asked, "asked")
    more = _together(asked.join(sets, "rep")).mapInArrow(_confirm, "a long, b long")
    more = scratch.save(more, "links-2")
    merged = components(links.unionByName(more), scratch, "second")

    # a component is known by its smallest doc_id, which its label is if classes are known by theirs
    named = classes.select("rep", "doc_id", "n", "f1", "f2").join(merged.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.save(named.withColumn("label", F.coalesce("label", "rep")), "labels-2")
    scratch.drop("live", "stars", "sets", "named", "sized", "open", "hot", "crowded", "full", "dear", "dealt", "asked", "links-1", "links-2", "labels-1", "found", "classes")
    own = named.withColumnRenamed("label", "component_id")
    if shared_ids:
        own = named.join(named.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    own = own.select("n", "f1", "f2", "component_id")
    with_words = told.select("doc_id", "text_key", "n", "f1", "f2").join(own, ["n", "f1", "f2"]).drop("f1", "f2")
    without = profiles.where((F.col("n") == 0) | F.col("doc_id").isNull())
    return with_words.unionByName(without.select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id")))


def _kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def near_duplicates(documents: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    judged = _judged(documents, k, scratch or Scratch(documents.sparkSession, "near"))
    return judged.select("doc_id", F.col("n").alias("n_shingles"), "component_id", _kept().alias("kept"))


def keep_one(documents: DataFrame, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """Documents without those that repeat a smaller document's text nearly; own columns only.

    Rows that repeat the document kept, in id and text, all stay.
    """
    gone = _judged(documents, k, scratch or Scratch(documents.sparkSession, "near")).where(~_kept())
    gone = gone.select(F.col("doc_id").alias("gone_doc"), F.col("text_key").alias("gone_text")).distinct()
    here = (F.col("doc_id").cast("long") == F.col("gone_doc")) & (F.xxhash64("text") == F.col("gone_text"))
    docs, own = aside(documents, "gone_doc", "gone_text")
    return docs.join(gone, here, "left_anti").select(*own)
