"""The search box: words and ``key:value`` terms over rows that say something and carry facets."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.scratch import Rounds

_TOKEN = re.compile(r'(?:"[^"]*"?|[^\s"])+')


def parse(search: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Words and terms of a search text; quotes hold a token together."""
    words, terms = [], []
    for raw in _TOKEN.findall(search.lower()):
        token = raw.replace('"', "")
        key, colon, value = token.partition(":")
        if colon and key:
            terms.append((key, value))
        elif token:
            words.append(token)
    return words, terms


def matches(search: str, said: Column, facets: Column) -> Column:
    """Every word is somewhere in what is said; every term is answered by a facet of its key."""
    words, terms = parse(search)
    asked = [F.contains(F.lower(F.coalesce(said, F.lit(""))), F.lit(w)) for w in words]
    asked += [_answered(facets, k, v) for k, v in terms]
    return reduce(Column.__and__, asked, F.lit(True))


def _answered(facets: Column, key: str, value: str) -> Column:
    return F.exists(facets, lambda f: (F.lower(f["key"]) == key) & F.coalesce(F.contains(F.lower(f["value"]), F.lit(value)), F.lit(False)))


def facet(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))


def any_field_contains(fields: list[str], text: str) -> Column:
    """Plain, case-folded substring in any of the fields; blank text asks nothing."""
    want = text.strip().lower()
    if not want:
        return F.lit(True)
    return reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(f)), F.lit(want)), F.lit(False)) for f in fields])


def with_marks(rows: DataFrame, marks: DataFrame, key: str, favourite: bool | None = None, tag: str | None = None) -> DataFrame:
    """Rows whose mark survives: favourites only, and a ``key`` or ``key:value`` tag held by it."""
    out = rows.join(marks.select(key, "favourite", "tags"), key, "left")
    keep = F.lit(True)
    if favourite:
        keep = keep & F.coalesce("favourite", F.lit(False))
    if tag:
        k, _, v = tag.lower().partition(":")
        held = F.exists("tags", lambda t: (F.lower(t["key"]) == k) & F.contains(F.lower(F.coalesce(t["value"], F.lit(""))), F.lit(v)))
        keep = keep & F.coalesce(held, F.lit(False))
    return out.where(keep).select(*rows.columns)


def tag_choices(tags: DataFrame) -> DataFrame:
    """Folded keys with their first spelling and their distinct folded values in order."""
    return tags.groupBy(F.lower("key").alias("key_fold")).agg(
        F.min("key").alias("spelling"), F.array_sort(F.collect_set(F.lower("value"))).alias("choices"), F.countDistinct("id").alias("n")
    )


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows with their place in one order over the whole table, from 1.

    The rows are dealt to ranges of the order, as many as the session has shuffle partitions, and
    written; each range is counted, and a row's place is its number in its range after the rows of
    the earlier ranges. ``order`` should tell rows apart, or equal ones share a task.
    """
    dealt = rows.withColumn("_key", F.struct(*order)).repartitionByRange("_key").withColumn("_span", F.spark_partition_id())
    cut = Rounds(rows.sparkSession, "placed").save(dealt)  # ranges are sampled, so both readers need the same ones
    small = W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = cut.groupBy("_span").agg(F.count("*").alias("_n")).select("_span", F.coalesce(F.sum("_n").over(small), F.lit(0)).alias("_start"))
    number = F.row_number().over(W.partitionBy("_span").orderBy("_key"))
    return cut.join(F.broadcast(starts), "_span").withColumn("place", (F.col("_start") + number).cast("int")).drop("_key", "_span", "_start")
