"""Audits of labelled pairs and of id-keyed records: counts, profiles, duplicates, overlaps.

Every report is one aggregation over the input, or one for each level of grouping; pivots
have a fixed domain of columns, so nothing is collected to plan them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions import predicates as P


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def split_counts(rows: DataFrame, expected: dict[str, int], split: str = "split") -> DataFrame:
    """A1: rows of each split beside the number expected."""
    spark = rows.sparkSession
    want = spark.createDataFrame(list(expected.items()), f"{split} string, expected long")
    found = rows.groupBy(split).agg(F.count("*").alias("n_rows"))
    return F.broadcast(want).join(found, split, "full").select(split, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "expected", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(False)).alias("as_expected"))


def class_balance(rows: DataFrame, falsified: str = "falsified", split: str = "split") -> DataFrame:
    """The three classes of each split, absent ones with 0, their percentage, and whether the split is balanced."""
    label = P.class_label(F.col(falsified))
    names = ("pristine", "falsified", "INVALID_OR_MISSING")
    per = rows.groupBy(split).agg(*[count_if(label == c).alias(c) for c in names], F.count("*").alias("total"))
    balanced = (F.col("pristine") == F.col("falsified")) & (F.col("pristine") > 0) & (F.col("INVALID_OR_MISSING") == 0)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in names]))
    return per.select(split, "total", balanced.alias("balanced"), cells.alias("x")).select(split, "x.class", "x.n", (F.col("x.n") * 100.0 / F.col("total")).alias("pct"), "balanced")


def field_profile(rows: DataFrame, json: str, split: str = "split") -> DataFrame:
    """A3: of each key of JSON objects: value types, missing, null, distinct values by type and form."""
    objects = rows.select(split, F.monotonically_increasing_id().alias("row"), F.try_parse_json(json).alias("v")).where(F.col("v").isNotNull())
    each = objects.select(split, F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("field", "value"))
    cells = each.select(split, "field", F.schema_of_variant("value").alias("type"), F.to_json("value").alias("form"), F.is_variant_null("value").alias("is_null"))
    n = objects.groupBy(split).agg(F.count("*").alias("n_objects"))
    per = cells.groupBy(split, "field").agg(F.count("*").alias("present"), count_if(F.col("is_null")).alias("n_null"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types_seen"), F.count_distinct(F.when(~F.col("is_null"), F.struct("type", "form"))).alias("n_distinct"))
    return per.join(F.broadcast(n), split).select(split, "field", "types_seen", (F.col("n_objects") - F.col("present")).alias("n_missing"), "n_null", (F.col("n_objects") - F.col("present") + F.col("n_null")).alias("missing_or_null"), "n_distinct")


def repeats(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Of each column: distinct values, rows beyond the first of a value, values that repeat."""
    cells = rows.select(split, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select(split, "x.field", "x.value")
    per = cells.where("value IS NOT NULL").groupBy(split, "field", "value").agg(F.count("*").alias("c"))
    return per.groupBy(split, "field").agg(F.count("*").alias("n_distinct"), F.sum(F.col("c") - 1).alias("repeated_rows"), count_if(F.col("c") > 1).alias("repeated_values"))


def id_relations(rows: DataFrame, split: str = "split") -> DataFrame:
    """A5: classes by how the pair's ids relate."""
    relation = F.when(~P.valid_id(F.col("id")) | ~P.valid_id(F.col("image_id")), "INVALID").when(F.col("id") == F.col("image_id"), "same").otherwise("different")
    return rows.groupBy(split, P.class_label(F.col("falsified")).alias("class"), relation.alias("relation")).agg(F.count("*").alias("n"))


def duplicate_rows(rows: DataFrame, keys: list[str], split: str = "split") -> DataFrame:
    """Rows beyond the first of each key, and keys that repeat; null is a value of its own."""
    per = rows.groupBy(split, F.struct(*[F.struct(F.col(k).isNotNull(), F.col(k)) for k in keys]).alias("k")).agg(F.count("*").alias("c"))
    return per.groupBy(split).agg(F.sum(F.col("c") - 1).alias("duplicate_rows"), count_if(F.col("c") > 1).alias("duplicate_groups"))


def source_classes(rows: DataFrame, names: Column, key: str, split: str = "split") -> DataFrame:
    """Classes by the resolved name of a source key."""
    return rows.groupBy(split, P.named(names, F.col(key)).alias("source_name"), P.class_label(F.col("falsified")).alias("class")).agg(F.count("*").alias("n"))


def score_summary(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Summary of the finite scores of each group."""
    s = F.when(P.finite(F.col(score)), F.col(score))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count(s).alias("n_scores"), (F.count("*") - F.count(s)).alias("excluded"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("mean_score"), F.median(s).alias("median_score"))


def scoreboard(rows: DataFrame, checks: dict[str, Column], splits: list[str], split: str = "split") -> DataFrame:
    """How often each check fails in each split, with one column a split."""
    counted = rows.groupBy(split).agg(*[count_if(c).alias(name) for name, c in checks.items()])
    long = counted.select(split, F.explode(F.create_map(*[x for name in checks for x in (F.lit(name), F.col(name))])).alias("check", "n"))
    wide = long.groupBy("check").pivot(split, splits).agg(F.sum("n")).na.fill(0)
    return wide.withColumn("anomaly", sum((F.col(s) for s in splits[1:]), F.col(splits[0])) > 0)


def suffixes(rows: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Rows of each lower-case suffix."""
    return histogram(rows.where(P.has_text(F.col(path))), split=F.col(split), suffix=P.suffix_of(F.col(path)))


def path_stats(rows: DataFrame, path: str, split: str = "split") -> DataFrame:
    """Missing, blank, distinct, repeated, malformed paths."""
    p = F.col(path)
    return rows.groupBy(split).agg(
        count_if(p.isNull()).alias("n_missing"), count_if(p.isNotNull() & ~P.has_text(p)).alias("n_blank"), F.count_distinct(p).alias("n_distinct"), (F.count(p) - F.count_distinct(p)).alias("repeated_rows"), count_if(P.malformed_path(p)).alias("n_malformed")
    )


def histogram(rows: DataFrame, **keys: Column) -> DataFrame:
    """Rows of each combination of keys."""
    return rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count("*").alias("n"))


def caption_lengths(rows: DataFrame, text: str, split: str = "split") -> DataFrame:
    """Lengths in code points of texts that hold something, and how many repeat."""
    kept = rows.where(P.has_text(F.col(text)))
    n = F.char_length(text)
    return kept.groupBy(split).agg(F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), (F.count("*") - F.count_distinct(text)).alias("duplicates"))


def value_pivot(rows: DataFrame, value: str, splits: list[str], split: str = "split") -> DataFrame:
    """Counts of a value with one column a split, and their total."""
    wide = rows.groupBy(value).pivot(split, splits).agg(F.count(F.lit(1))).na.fill(0, splits)
    return wide.withColumn("total", sum((F.col(s) for s in splits[1:]), F.col(splits[0])))


def missing_share(rows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """Of each column, blank values and their percentage."""
    counted = rows.groupBy(split).agg(F.count("*").alias("n_rows"), *[count_if(~P.has_text(F.col(c))).alias(c) for c in columns])
    long = counted.select(split, "n_rows", F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("field", "n_blank"))
    return long.withColumn("pct", F.col("n_blank") * 100.0 / F.col("n_rows"))


def timestamp_profile(rows: DataFrame, text: str, split: str = "split") -> DataFrame:
    """How far texts parse as timestamps, and their range."""
    c, t = F.col(text), P.text_timestamp(F.col(text))
    return rows.groupBy(split).agg(count_if(c.isNull()).alias("n_missing"), count_if(c.isNotNull() & ~P.has_text(c)).alias("n_blank"), F.count(t).alias("parseable"), count_if(P.has_text(c) & t.isNull()).alias("unparseable"), F.date_format(F.min(t), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max(t), "yyyy-MM-dd HH:mm:ss").alias("last"))


def array_profile(rows: DataFrame, array: str, split: str = "split") -> DataFrame:
    """Missing and empty arrays, entries, lengths of entries, the smallest example."""
    a = F.col(array)
    return rows.groupBy(split).agg(
        count_if(a.isNull()).alias("n_missing"), count_if(F.size(a) == 0).alias("n_empty"), F.min(F.when(F.size(a) > 0, F.size(a))).alias("min_entries"), F.max(F.when(F.size(a) >= 0, F.size(a))).alias("max_entries"), F.max(F.array_max(F.transform(a, F.char_length))).alias("longest_entry"), F.min(F.array_min(a)).alias("least_entry")
    )


def overlap(rows: DataFrame, field: str, split: str = "split") -> DataFrame:
    """Of each pair of splits, how many values of a field both hold."""
    sets = rows.where(F.col(field).isNotNull()).select(split, field).distinct()
    per = sets.groupBy(field).agg(F.array_sort(F.collect_set(split)).alias("s"))  # as many splits as there are
    pairs = per.where(F.size("s") > 1).select(F.explode(F.filter(F.flatten(F.transform("s", lambda x: F.transform("s", lambda y: F.struct(x.alias("a"), y.alias("b"))))), lambda p: p["a"] < p["b"])).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("n_shared"))


def first_in_group(rows: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first rows of each group in an order with a unique tie-break."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def size_distribution(rows: DataFrame, key: str, kinds: str, values: list[str]) -> DataFrame:
    """How many groups have each size, by kind."""
    sizes = rows.groupBy(kinds, key).agg(F.count("*").alias("size"))
    wide = sizes.groupBy("size").pivot(kinds, values).agg(F.count(F.lit(1))).na.fill(0, values)
    return wide.withColumn("total", sum((F.col(s) for s in values[1:]), F.col(values[0])))


def key_checks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Of each column, nulls and values beyond the distinct ones."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.field", "x.value")
    return cells.groupBy("field").agg(F.count("*").alias("n_rows"), count_if(F.col("value").isNull()).alias("n_null"), (F.count("value") - F.count_distinct("value")).alias("n_repeated"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles and bounds of numeric columns."""
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("c")).select("c.field", "c.x")
    q = lambda p: F.percentile("x", F.lit(p))
    return cells.groupBy("field").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("x").alias("high"))
