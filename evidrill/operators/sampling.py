"""Reproducible samples: order by a keyed hash, so any engine draws the same rows."""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.functions import predicates as P


def lot(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def per_group(rows: DataFrame, by: list[str], key: str, n: int | Column, seed: int) -> DataFrame:
    """The first ``n`` rows of each group in hash order."""
    w = Window.partitionBy(*by).orderBy(lot(seed, F.col(key)), key)
    return rows.withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def quotas(groups: DataFrame, total: int, group: str, taken: str) -> DataFrame:
    """``total`` dealt evenly over groups in order, the first ones one more, less what each has already.

    ``groups`` has one row a group, so one window over it is small.
    """
    w = Window.orderBy(group)
    n = F.count("*").over(Window.partitionBy())
    share = F.floor(F.lit(total) / n) + F.when(F.row_number().over(w) <= F.lit(total) % n, 1).otherwise(0)
    return groups.withColumn("quota", F.greatest(share - F.col(taken), F.lit(0)).cast("long"))


def quota_sample(pool: DataFrame, quota: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    """Each group's first ``quota`` rows in hash order."""
    return per_group(pool.join(F.broadcast(quota.select(group, "quota")), group), [group], key, F.col("quota"), seed)


def provenance(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a query's caption or image comes from, with their role."""
    c = queries.select(F.col("id").alias("rid")).distinct().withColumn("as_caption", F.lit(True))
    i = queries.select(F.col("image_id").alias("rid")).distinct().withColumn("as_image", F.lit(True))
    roles = records.join(c, F.col("id") == c["rid"], "left").drop("rid").join(i, F.col("id") == i["rid"], "left").drop("rid")
    ac, ai = F.coalesce("as_caption", F.lit(False)), F.coalesce("as_image", F.lit(False))
    return roles.select(*records.columns, (ac | ai).alias("is_query_provenance"), P.role(ac, ai, "both", "caption", "image", "background").alias("provenance_role"))


def exclusion_reasons(records: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """The first rule that excludes a record; null if it stays."""
    return records.withColumn("reason", P.first_reason(*rules))


def greedy(rows: DataFrame, group: str, order: list[str], distinct: list[list[str]], n: int, seed: int, key: str, pool: int = 64) -> DataFrame:
    """G1: groups in order, each in hash order; a row is taken if none taken before shares any of the distinct keys.

    What a row may share depends on all rows taken before, so the choice is sequential.  It
    looks at ``pool * n`` candidates of each of the groups named in ``order`` at once; while a
    group is short, it goes on with the next rows that share nothing with those taken.
    ValueError if a group has fewer than ``n`` such rows.
    """
    names = sorted({c for d in distinct for c in d} | {group, key})
    seen: list[set] = [set() for _ in distinct]
    out: list[tuple] = []
    taken: list[tuple] = []
    got = dict.fromkeys(order, 0)
    open_, left = list(order), rows
    while open_:
        found = defaultdict(list)
        for r in per_group(left.where(F.col(group).isin(open_)), [group], key, pool * n, seed).select(*names, "draw").collect():  # pool * n of each group at most
            found[r[group]].append(r)
        for g in list(open_):
            for r in sorted(found[g], key=lambda r: r["draw"]):
                keys = [tuple(r[c] for c in d) for d in distinct]
                if got[g] < n and not any(k in s for k, s in zip(keys, seen, strict=True)):
                    got[g] += 1
                    out.append((g, r[key], got[g]))
                    taken.append(tuple(r[c] for c in names))
                    for k, s in zip(keys, seen, strict=True):
                        s.add(k)
            if got[g] < n:
                if len(found[g]) < pool * n:
                    raise ValueError(f"group {g!r} has {got[g]} of {n} rows that share nothing")
                break  # more of this group before the next one
            open_.remove(g)
        left = rows
        if open_ and taken:
            known = rows.sparkSession.createDataFrame(taken, rows.select(*names).schema)
            for d in distinct:
                k = known.select(*[F.col(c).alias(f"__{c}") for c in d]).distinct()  # n rows of each group at most
                left = left.join(F.broadcast(k), reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in d]), "left_anti")
    return rows.sparkSession.createDataFrame(out, T.StructType([rows.schema[group], rows.schema[key], T.StructField("place", T.LongType())]))
