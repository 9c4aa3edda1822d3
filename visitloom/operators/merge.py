"""Writes as dataflow: each merge rule makes the new table out of the old one and a batch.

All rules are idempotent: a batch applied twice changes nothing the second time (but for
``accumulate``, which is meant to add). Keys are compared null-safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(old: DataFrame, new: DataFrame, keys: list[str], how: str = "full") -> DataFrame:
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns], F.lit(True).alias("o_there"))
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("n_there"))
    on = reduce(Column.__and__, [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys])
    return o.join(n, on, how)


def _key(k: str) -> Column:
    return F.when(F.col("n_there"), F.col(f"n_{k}")).otherwise(F.col(f"o_{k}")).alias(k)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None, default: str = "last") -> DataFrame:
    """Old rows updated by new ones, new rows added. A column's rule says which value stays.

    last: the new one. coalesce: the new one unless null. fill: the old one unless null.
    sticky: true stays true. add: the sum. known: the new one unless it is ``unknown``.
    """
    both = _sides(old, new, keys)
    stays = {
        "last": lambda o, n: n,
        "coalesce": lambda o, n: F.coalesce(n, o),
        "fill": lambda o, n: F.coalesce(o, n),
        "sticky": lambda o, n: F.coalesce(o, F.lit(False)) | F.coalesce(n, F.lit(False)),
        "add": lambda o, n: F.coalesce(o, F.lit(0)) + F.coalesce(n, F.lit(0)),
        "known": lambda o, n: F.when(F.coalesce(n, F.lit("unknown")) != "unknown", n).otherwise(F.coalesce(o, n)),
    }

    def value(c: str) -> Column:
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        met = stays[(rules or {}).get(c, default)](o, n)
        return F.when(F.col("o_there").isNull(), n).when(F.col("n_there").isNull(), o).otherwise(met).alias(c)

    return both.select(*[_key(k) for k in keys], *[value(c) for c in old.columns if c not in keys])


def change_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of the batch are added and how many update."""
    there = _sides(old, new, keys, "right")
    return there.agg(F.count_if(F.col("o_there").isNull()).alias("added"), F.count_if(F.col("o_there").isNotNull()).alias("updated"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is already there are ignored."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_groups(old: DataFrame, new: DataFrame, group: list[str], touched: DataFrame | None = None) -> DataFrame:
    """All rows of each touched group are replaced by the batch's; a touched group may become empty."""
    seen = (new if touched is None else touched).select(*group).distinct()
    return old.join(seen, group, "left_anti").unionByName(new.select(*old.columns))


def prune_if_complete(held: DataFrame, walked: DataFrame, claims: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Held rows of complete scopes that the walk no longer met are dropped; incomplete scopes only grow."""
    complete = claims.where(F.col("complete")).select(*scope)
    gone = held.join(complete, scope, "left_semi").join(walked.select(*scope, key).distinct(), [*scope, key], "left_anti")
    return held.join(gone.select(*scope, key), [*scope, key], "left_anti")


def first_outcome(requests: DataFrame, outcomes: DataFrame, key: str = "request_id") -> DataFrame:
    """Each request with the outcome that came first; a request that has one keeps it."""
    first = outcomes.groupBy(key).agg(F.min_by("outcome", "seq").alias("_first"))
    return requests.join(first, key, "left").withColumn("outcome", F.coalesce("outcome", "_first")).drop("_first")


def bury(rows: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """Rows that no tombstone names; a later sync cannot bring them back."""
    return rows.join(tombstones.select(key).distinct(), key, "left_anti")


def suppress(inferred: DataFrame, manual: DataFrame, suppressions: DataFrame, keys: list[str]) -> DataFrame:
    """Inferred rows without the suppressed ones, and the manual rows beside them."""
    return inferred.join(suppressions.select(*keys).distinct(), keys, "left_anti").unionByName(manual, allowMissingColumns=True)


def cascade(tables: dict[str, DataFrame], deleted: DataFrame, parent: str, rules: list[tuple[str, str, str, str, str]]) -> dict[str, DataFrame]:
    """Delete rows of ``parent`` and what hangs on them.

    A rule is (parent table, parent key, child table, child column, ``delete`` or ``null``);
    rules are followed down in their order.
    """
    out, gone = dict(tables), {parent: deleted}
    pk = next(r[1] for r in rules if r[0] == parent)
    out[parent] = out[parent].join(deleted.select(pk), pk, "left_anti")
    for owner, key, child, column, action in rules:
        if owner not in gone:
            continue
        ids = gone[owner].select(F.col(key).alias(column)).distinct()
        if action == "delete":
            lost = out[child].join(ids, column, "left_semi")
            gone[child] = lost if child not in gone else gone[child].unionByName(lost)
            out[child] = out[child].join(ids, column, "left_anti")
        else:
            hit = ids.withColumn("_hit", F.lit(True))
            out[child] = out[child].join(hit, column, "left").withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).drop("_hit")
    return out


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows created, deleted or updated between two snapshots, with old and new values."""
    both = _sides(before, after, keys)
    same = reduce(Column.__and__, [F.col(f"o_{v}").eqNullSafe(F.col(f"n_{v}")) for v in values])
    kind = F.when(F.col("o_there").isNull(), "created").when(F.col("n_there").isNull(), "deleted").when(~same, "updated")
    return both.withColumn("change", kind).where("change is not null").select(
        *[_key(k) for k in keys], "change", *[F.col(f"o_{v}").alias(f"{v}_before") for v in values], *[F.col(f"n_{v}").alias(f"{v}_after") for v in values]
    )
