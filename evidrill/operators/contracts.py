"""Contracts: each gives (check, n) with n the number of violations; a stage stops on any."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators.audit import count_if


class ContractError(ValueError):
    pass


def long(counts: DataFrame) -> DataFrame:
    """One row of counts as (check, n)."""
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in counts.columns])).alias("x")).select("x.*")


def checks(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass."""
    return long(rows.agg(*[count_if(c).alias(name) for name, c in rules.items()]))


def required(rows: DataFrame, columns: list[str], size: int | None = None) -> DataFrame:
    """V1: missing columns, nulls in columns, and whether the size is another."""
    have = [c for c in columns if c in rows.columns]
    counted = rows.agg(*[count_if(F.col(c).isNull()).alias(f"null:{c}") for c in have], *[F.lit(1).alias(f"absent:{c}") for c in columns if c not in have], *([(F.count("*") != size).cast("long").alias("size")] if size is not None else []))
    return long(counted)


def unique(rows: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    out = None
    for k in keys:
        one = rows.groupBy(*k).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("repeated:" + ",".join(k)).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def asset_manifest(rows: DataFrame, root: str, publishers: list[str]) -> DataFrame:
    """V2: paths safe and well-formed, publisher as in the path, role as the flags say, archive names unique."""
    role = P.role(F.col("is_query"), F.col("is_evidence"), "both", "query_only", "evidence_only")
    rules = {"unsafe_path": P.unsafe_path_reason(F.col("image_path")).isNotNull(), "malformed": ~P.asset_path_ok(F.col("image_path"), root, publishers), "publisher": ~P.path_part(F.col("image_path"), len(root.split("/"))).eqNullSafe(F.col("source")), "role": ~role.eqNullSafe(F.col("asset_role"))}
    return checks(rows, rules).unionByName(unique(rows, ["image_path"]))


def record_manifest(rows: DataFrame, forbidden: list[str], split: str = "train") -> DataFrame:
    """Ids at least 0, captions with text, one split, unique ids and paths, no forbidden column."""
    rules = {"id": ~P.valid_id(F.col("id")), "caption": ~P.has_text(F.col("caption")), "split": ~F.col("split").eqNullSafe(F.lit(split))}
    spare = rows.sparkSession.createDataFrame([(f"forbidden:{c}", 1) for c in P.forbidden_columns(rows.columns, forbidden)], "check string, n long")
    return checks(rows, rules).unionByName(unique(rows, ["id"], ["image_path"])).unionByName(spare)


def selection(rows: DataFrame, per_cell: int, cells: int) -> DataFrame:
    """V4: cells complete and of one size; captions, paths and pairs unique; ids there; class as the ids say."""
    sizes = rows.groupBy("falsified", "category").agg(F.count("*").alias("c")).agg(count_if(F.col("c") != per_cell).alias("cell_size"), (F.count("*") != cells).cast("long").alias("cells"))
    rules = {"id": ~P.valid_id(F.col("id")), "image_id": ~P.valid_id(F.col("image_id")), "caption": ~P.has_text(F.col("caption")), "class": F.col("falsified") == (F.col("id") == F.col("image_id"))}
    return long(sizes).unionByName(checks(rows, rules)).unionByName(unique(rows, ["caption"], ["image_path"], ["id", "image_id"]))


def annotation(rows: DataFrame) -> DataFrame:
    """V8, V9: allowed labels and states; score a whole 0 to 100 that fits its band; low scores flagged; flags and REVIEW agree; a web check has a note."""
    score = P.whole_score(F.col("confidence_score"))
    active = F.col("event_label") != ""
    rules = {
        "label": ~F.col("event_label").isin("", "SAME", "RELATED", "IRRELEVANT"), "status": ~F.col("status").isin("UNLABELED", "LABELED", "REVIEW"), "score": active & score.isNull(), "band": active & ~P.confidence_band(score).eqNullSafe(F.col("confidence")),
        "low_unflagged": active & (score < 85) & ~P.flag(F.col("needs_review")), "flag_status": active & (P.flag(F.col("needs_review")) != (F.col("status") == "REVIEW")), "web_note": P.flag(F.col("web_checked")) & ~P.has_text(F.col("web_evidence_note")),
    }
    return checks(rows, rules)


def deeper_labels(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Keys unique and not among the old; labels allowed; ranks beyond 5; the flag of a positive as its label says.  Either table is read once."""
    rules = {"label": ~F.coalesce(F.col("event_label").isin("SAME", "RELATED", "IRRELEVANT"), F.lit(False)), "rank": F.coalesce(F.col("rank") <= 5, F.lit(True)), "flag": ~F.col("is_nontrivial_same").eqNullSafe(F.col("event_label") == "SAME")}
    both = new.select(*keys, F.lit(True).alias("__new"), *[r.alias(f"__{c}") for c, r in rules.items()]).unionByName(old.select(*keys, F.lit(False).alias("__new")), allowMissingColumns=True)
    per = both.groupBy(*keys).agg(count_if(F.col("__new")).alias("n"), count_if(~F.col("__new")).alias("n_old"), *[count_if(F.col(f"__{c}")).alias(c) for c in rules])
    met = reduce(and_, [F.col(k).isNotNull() for k in keys], F.col("n_old") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return long(per.agg(*[total(c).alias(c) for c in rules], total(F.when(F.col("n") > 0, F.col("n") - 1)).alias("repeated:" + ",".join(keys)), total(F.when(met, F.col("n"))).alias("already_labelled")))


def coverage(table: DataFrame) -> DataFrame:
    """Rates in [0, 1], never falling with depth; the union at least each channel and at most their sum.  ``table`` has a row for each of a few scopes and depths, and is read once."""
    rows = F.col("rows")
    n = lambda x: F.coalesce(x["n_covered"], F.lit(0))
    channels = lambda x: F.filter(rows, lambda y: (y["scope"] != "union") & (y["depth"] == x["depth"]) & y["n_covered"].isNotNull())
    of_union = F.filter(rows, lambda x: x["scope"] == "union")
    falls = lambda a: F.size(F.filter(rows, lambda b: (a["scope"] == b["scope"]) & (a["depth"] < b["depth"]) & (a["rate"] > b["rate"])))
    return long(table.agg(F.collect_list(F.struct("scope", "depth", "n_covered", "rate")).alias("rows")).select(
        F.size(F.filter(rows, lambda x: ~x["rate"].between(0, 1))).alias("rate"),
        F.size(F.filter(of_union, lambda x: F.exists(channels(x), lambda y: x["n_covered"] < y["n_covered"]))).alias("union_low"),
        F.size(F.filter(of_union, lambda x: (F.size(channels(x)) > 0) & (x["n_covered"] > F.aggregate(channels(x), F.lit(0).cast("long"), lambda s, y: s + n(y))))).alias("union_high"),
        F.aggregate(rows, F.lit(0), lambda s, a: s + falls(a)).alias("falls"),
    ))


def byte_identity(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """Equal bytes must be flagged, and the exact flag must mean equal bytes."""
    h = lambda c: hashes.select(F.col("image_path").alias(c), F.col("sha256").alias(f"{c}_sha"))
    both = pairs.join(h("query_path"), "query_path", "left").join(h("candidate_path"), "candidate_path", "left")
    same = F.col("query_path_sha") == F.col("candidate_path_sha")
    return checks(both, {"unflagged": same & ~F.coalesce(F.col("is_exact"), F.lit(False)), "not_identical": F.col("is_exact") & ~F.coalesce(same, F.lit(False))})


def same_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """V6: rows of either table that the other lacks, repeats counted."""
    left = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("only_left").alias("check"), "n")
    return left.unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("only_right").alias("check"), "n"))


def contained(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the left that the right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n")).select(F.lit("not_contained").alias("check"), "n")


def enforce(found: DataFrame) -> None:
    """Raises if any check has violations; ``found`` has one row a check."""
    bad = found.where("n > 0").collect()
    if bad:
        raise ContractError("; ".join(f"{r['check']}: {r['n']}" for r in bad))
