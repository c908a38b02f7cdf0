"""Two-role links from pairs to one record table, and what their coverage shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators.audit import count_if


def link(pairs: DataFrame, records: DataFrame, carried: list[str], caption: str = "caption") -> DataFrame:
    """Every pair with the records of its ``id`` (caption_*) and its ``image_id`` (image_*).

    ``records`` has one row an id.  captions_equal is null unless both records are there; two
    null captions are equal.
    """
    side = lambda role: records.select(F.col("id").alias(f"{role}_key"), *[F.col(c).alias(f"{role}_{c}") for c in carried], F.lit(True).alias(f"{role}_found"), _print(F.col(caption)).alias(f"{role}_print"))
    both = pairs.join(side("caption"), F.col("id") == F.col("caption_key"), "left").join(side("image"), F.col("image_id") == F.col("image_key"), "left")
    both = both.withColumns({f"{r}_found": F.coalesce(f"{r}_found", F.lit(False)) for r in ("caption", "image")})
    found = F.col("caption_found") & F.col("image_found")
    same = F.when(found, F.col("caption_print").eqNullSafe(F.col("image_print")))
    out = both.drop("caption_key", "image_key").withColumns({"same_record": F.coalesce(F.col("id") == F.col("image_id"), F.lit(False)), "both_found": found, "captions_equal": same})
    return out.drop("caption_print", "image_print")


def _print(text: Column) -> Column:
    """128 bits that stand for a text, so that comparing texts doesn't carry them through a shuffle."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit(1)).alias("b"), text.isNull().alias("null"))


def coverage(linked: DataFrame, by: list[str]) -> DataFrame:
    """Found in either role, in both, in none, and the share in both."""
    c, i = F.col("caption_found"), F.col("image_found")
    return linked.groupBy(*by).agg(F.count("*").alias("n_rows"), count_if(c).alias("n_caption"), count_if(i).alias("n_image"), count_if(c & i).alias("n_both"), count_if(~c & ~i).alias("n_none"), (count_if(c & i) * 100.0 / F.count("*")).alias("pct_both"))


def split_agreement(linked: DataFrame, split: str = "split") -> DataFrame:
    """Whether the record of either role lies in the pair's own split."""
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_found").alias("found"), F.col(f"{r}_split").alias("other")) for r in ("caption", "image")])
    cells = linked.select(split, F.explode(roles).alias("x")).select(split, "x.*").where("found")
    return cells.groupBy(split, "role").agg(count_if(F.col("other") == F.col(split)).alias("same_split"), count_if(F.col("other") != F.col(split)).alias("other_split"))


def class_invariants(linked: DataFrame) -> DataFrame:
    """A pristine pair is one record; a falsified one is two."""
    return linked.groupBy(P.class_label(F.col("falsified")).alias("class")).agg(F.count("*").alias("n_rows"), count_if(F.col("same_record")).alias("one_record"), count_if(F.col("captions_equal")).alias("equal_captions"), count_if(F.col("captions_equal").isNull()).alias("unknown"))


def source_pairs(linked: DataFrame) -> DataFrame:
    """Pairs of sources; equal only if both are there and the same (two nulls differ)."""
    a, b = F.col("caption_source"), F.col("image_source")
    return linked.where("both_found").groupBy(a, b).agg(F.count("*").alias("n"), F.max(F.coalesce(a == b, F.lit(False))).alias("same_source"))


def missing_ids(linked: DataFrame) -> DataFrame:
    """Ids that no record has, by role, and how often they come."""
    roles = F.array(F.struct(F.lit("caption").alias("role"), F.col("id").alias("key"), F.col("caption_found").alias("found")), F.struct(F.lit("image").alias("role"), F.col("image_id").alias("key"), F.col("image_found").alias("found")))
    return linked.select(F.explode(roles).alias("x")).select("x.*").where(~F.col("found")).groupBy("role", "key").agg(F.count("*").alias("n"))


def repeated_members(rows: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows whose value comes more than once."""
    n = F.count("*").over(Window.partitionBy(column))
    return rows.where(F.col(column).isNotNull()).withColumn("n_same", n).where("n_same > 1").select(*keep, "n_same")


def require(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner lookup that fails on the first key without a partner."""
    checked = left.join(right.withColumn("__found", F.lit(True)), key, "left")
    return checked.withColumn("__found", F.when(F.col("__found"), True).otherwise(F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).where("__found").drop("__found")


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that come more than once; a many-to-one join wants none on its right."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def inventory(left: DataFrame, right: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Union of two keyed tables with membership, role and whether they disagree."""
    a = left.select(key, *[F.col(c).alias(f"a_{c}") for c in carried], F.lit(True).alias("in_a"))
    b = right.select(key, *[F.col(c).alias(f"b_{c}") for c in carried], F.lit(True).alias("in_b"))
    both = a.join(b, key, "full")
    ia, ib = F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False))
    differ = F.lit(False)
    for c in carried:
        differ = differ | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return both.select(key, *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in carried], ia.alias("is_query"), ib.alias("is_evidence"), P.role(ia, ib, "both", "query_only", "evidence_only").alias("asset_role"), (ia & ib & differ).alias("conflict"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(keys, column, left, right) of every cell that differs; a missing row differs as a whole."""
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    both = left.withColumn("__a", F.lit(True)).alias("a").join(right.withColumn("__b", F.lit(True)).alias("b"), on, "full")
    kinds = dict(left.dtypes)
    cells = [F.struct(F.lit("(row)").alias("column"), F.when(F.col("__a"), "present").alias("left"), F.when(F.col("__b"), "present").alias("right"), (F.col("__a").isNull() | F.col("__b").isNull()).alias("differs"))]
    for c in columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)) if kinds[c] in ("double", "float") else x.eqNullSafe(y)
        cells.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"), (F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~same).alias("differs")))
    return both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.explode(F.array(*cells)).alias("x")).where("x.differs").select(*keys, "x.column", "x.left", "x.right")


#: Passages whose anchors are sent to every task; more are joined by a shuffle.
SENT = 100_000


def contained_passages(texts: DataFrame, passages: DataFrame, text: str, passage: str) -> DataFrame:
    """Rows of ``texts`` beside each of ``passages`` that they contain, each pair once.

    A passage is known by the hash of its second to fourth word, which any text that contains it
    has between blanks too; whole passages are compared where such hashes meet.  Passages of fewer
    than five words are compared with every text; more than 10,000 of those are an error.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda x: x != "")
    gram = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    known = passages.where(F.length(passage) > 0).withColumn("__w", words(F.col(passage)))
    long = known.where(F.size("__w") >= 5).withColumn("__h", gram(F.col("__w"), F.lit(1))).drop("__w")
    short = known.where(F.size("__w") < 5).drop("__w")
    rows = texts.where(F.col(text).isNotNull())
    cut = rows.withColumn("__w", words(F.col(text)))
    grams = F.when(F.size("__w") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: gram(F.col("__w"), i)))).otherwise(F.array().cast("array<bigint>"))
    cut = cut.select(*texts.columns, F.explode(grams).alias("__h"))
    found = cut.join(F.broadcast(long) if long.limit(SENT + 1).count() <= SENT else long, "__h").where(F.contains(text, passage)).select(*texts.columns, *passages.columns)
    few = short.limit(10_001).count()
    if few > 10_000:
        raise ValueError("too many passages of fewer than five words")
    return found.unionByName(rows.join(F.broadcast(short), F.contains(text, passage)).select(*texts.columns, *passages.columns)) if few else found
