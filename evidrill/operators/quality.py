"""Scoreboards over raw JSON rows, structure profiles, provenance and evidence summaries, alignment of tables.

A JSON row is read as a variant, so types, missing keys and nulls show as they stand.  NaN and
infinities, which strict JSON lacks, are marked before parsing.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators import contracts
from evidrill.operators.audit import count_if

# The fields of a labelled pair and of a record, with the kinds of value that each allows.
PAIR_KINDS = {"id": ["BIGINT"], "image_id": ["BIGINT"], "similarity_score": ["BIGINT", "DECIMAL", "DOUBLE"], "source_dataset": ["BIGINT"], "falsified": ["BOOLEAN"]}
RECORD_KINDS = {
    "id": ["BIGINT"], "caption": ["STRING"], "image_path": ["STRING"], "article_path": ["STRING"], "full_article_path": ["STRING"], "caption_entities_spacy": ["ARRAY"], "caption_entities_rel": ["ARRAY"],
    "image_has_person": ["BOOLEAN"], "topic": ["STRING"], "source": ["STRING"], "timestamp": ["STRING"], "title": ["STRING", "VOID"], "title_entities_spacy": ["ARRAY"],
}
_MARK = "\x01"


def _parsed(json: str) -> Column:
    return F.try_parse_json(F.regexp_replace(json, r"([:\[,]\s*)(NaN|-?Infinity)\b", '$1"\\\\u0001$2"'))


def _kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, BOOLEAN, ARRAY, OBJECT or VOID; null if the key is missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _cells(rows: DataFrame, json: str) -> DataFrame:
    """``rows`` with v, the parsed value, and m, its fields if it is an object."""
    return rows.withColumn("v", _parsed(json)).withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))


def _text(field: str) -> Column:
    return F.try_variant_get(F.try_element_at("m", F.lit(field)), "$", "string")


def _odd(field: str, kinds: list[str], nulls: bool) -> Column:
    """The field is there with a value of another kind; ``nulls``: also if it is null."""
    k = _kind(F.try_element_at("m", F.lit(field)))
    fine = k.isin(kinds) | (k == "VOID" if not nulls else F.lit(False))
    if "DOUBLE" in kinds:
        fine = fine | _text(field).startswith(_MARK)
    return F.coalesce(~fine, F.lit(False))


def _other_keys(kinds: dict) -> Column:
    return ~F.coalesce(F.array_sort(F.map_keys("m")) == F.array(*[F.lit(f) for f in sorted(kinds)]), F.lit(False))


def _long(counts: DataFrame, split: str) -> DataFrame:
    return counts.select(split, F.explode(F.create_map(*[x for c in counts.columns if c != split for x in (F.lit(c), F.col(c).cast("long"))])).alias("check", "n"))


def _pivoted(long: DataFrame, splits: list[str], split: str) -> DataFrame:
    wide = long.groupBy("check").pivot(split, splits).agg(F.sum("n")).na.fill(0)
    return wide.withColumn("anomaly", reduce(or_, (F.col(s) > 0 for s in splits)))


def _beyond_first(rows: DataFrame, key: list[Column], split: str, name: str) -> DataFrame:
    per = rows.groupBy(split, F.struct(*key).alias("k")).agg(F.count("*").alias("c"))
    return per.groupBy(split).agg(F.sum(F.col("c") - 1).alias("n")).select(split, F.lit(name).alias("check"), "n")


def pair_scoreboard(rows: DataFrame, json: str, names: DataFrame, expected: dict[str, int], split: str = "split") -> DataFrame:
    """Sixteen checks of raw pairs by split.  ``names``: (split, key, name) of the source lookups, one small table."""
    r = _cells(rows, json)
    get = lambda f: F.try_element_at("m", F.lit(f))
    total = lambda each: reduce(lambda a, b: a + b, (F.coalesce(x.cast("int"), F.lit(0)) for x in each))
    known = names.where(F.col("key").rlike("^[0-9]+$") & P.has_text(F.col("name"))).select(F.col(split), F.col("key").alias("source_key"), F.lit(True).alias("known")).distinct()
    r = r.withColumn("source_key", F.when(_kind(get("source_dataset")) == "BIGINT", _text("source_dataset"))).join(F.broadcast(known), [split, "source_key"], "left")
    score = F.when(_text("similarity_score").startswith(_MARK), F.substring(_text("similarity_score"), 2, 9))
    number = _kind(get("similarity_score")).isin(PAIR_KINDS["similarity_score"])
    counts = r.groupBy(split).agg(
        F.sum(total(get(f).isNull() for f in PAIR_KINDS)).alias("missing_fields"),
        F.sum(total(_kind(get(f)) == "VOID" for f in PAIR_KINDS)).alias("null_fields"),
        F.sum(total(_odd(f, k, False) for f, k in PAIR_KINDS.items())).alias("unexpected_types"),
        count_if(_other_keys(PAIR_KINDS)).alias("unexpected_or_absent_fields"),
        count_if(~(_kind(get("falsified")) == "BOOLEAN") | get("falsified").isNull()).alias("invalid_booleans"),
        count_if(score == "NaN").alias("nan_scores"),
        count_if(score.endswith("Infinity")).alias("infinite_scores"),
        count_if(~F.coalesce(number, F.lit(False))).alias("invalid_scores"),
        count_if(F.col("known").isNull()).alias("invalid_sources"),
        count_if(~P.strict_id(get("id"))).alias("invalid_id"),
        count_if(~P.strict_id(get("image_id"))).alias("invalid_image_id"),
    )
    form = F.to_json("v")
    sizes = rows.sparkSession.createDataFrame(list(expected.items()), f"{split} string, expected long").join(rows.groupBy(split).agg(F.count("*").alias("c")), split, "left")
    parts = [
        _long(counts, split),
        _beyond_first(r, [form], split, "duplicate_rows"),
        _beyond_first(r, [F.to_json(get("id")), F.to_json(get("image_id"))], split, "duplicate_combinations"),
        names.groupBy(split).agg(count_if(~(F.col("key").rlike("^[0-9]+$") & P.has_text(F.col("name")))).alias("n")).select(split, F.lit("invalid_lookup_entries").alias("check"), "n"),
        sizes.join(names.groupBy(split).agg(F.count("*").alias("n_names")), split, "left").select(split, F.lit("empty_structures").alias("check"), (F.col("c").isNull().cast("long") + F.col("n_names").isNull().cast("long")).alias("n")),
        sizes.select(split, F.lit("size_differs").alias("check"), (F.coalesce("c", F.lit(0)) != F.col("expected")).cast("long").alias("n")),
    ]
    return _pivoted(reduce(DataFrame.unionByName, parts), list(expected), split)


def record_scoreboard(rows: DataFrame, key: str, json: str, sources: list[str], splits: list[str], split: str = "split") -> DataFrame:
    """A10: fifteen checks of raw records, keyed by id, by split."""
    r = _cells(rows, json)
    get = lambda f: F.try_element_at("m", F.lit(f))
    whole = r.where("m IS NOT NULL")
    text = lambda f: F.when(_kind(get(f)) == "STRING", _text(f))
    paths = ("image_path", "article_path", "full_article_path")
    counts = whole.groupBy(split).agg(
        count_if(_other_keys(RECORD_KINDS)).alias("inconsistent_schemas"),
        F.sum(reduce(lambda a, b: a + b, (_odd(f, k, True).cast("int") for f, k in RECORD_KINDS.items()))).alias("invalid_types"),
        count_if(~P.strict_id(get("id"))).alias("invalid_ids"),
        count_if(~F.coalesce(P.strict_id(get("id")) & (_text("id") == F.col(key)), F.lit(False))).alias("key_mismatches"),
        count_if(~P.has_text(text("caption"))).alias("blank_captions"),
        *[count_if(~P.has_text(text(f))).alias(f"blank_{f}s") for f in paths],
        count_if(~F.coalesce(text("source").isin(sources), F.lit(False))).alias("unexpected_sources"),
        count_if(P.text_timestamp(text("timestamp")).isNull()).alias("invalid_timestamps"),
        F.sum(reduce(lambda a, b: a + b, (F.coalesce(P.malformed_path(text(f)), F.lit(False)).cast("int") for f in paths))).alias("malformed_paths"),
        count_if(~P.has_text(text("title"))).alias("blank_titles"),
    )
    per = r.groupBy(split).agg(count_if(F.col("m").isNull()).alias("malformed_records"), (F.count("*") == 0).cast("long").alias("empty_objects"))
    ids = _beyond_first(whole.where(P.strict_id(get("id"))), [_text("id")], split, "duplicate_ids")
    return _pivoted(_long(counts, split).unionByName(_long(per, split)).unionByName(ids), splits, split)


def structure(rows: DataFrame, key: str, json: str, split: str = "split") -> DataFrame:
    """Items of each keyed object, whether all keys are decimal, the first keys, and the kinds of its values."""
    r = rows.select(split, key, F.coalesce(_kind(_parsed(json)), F.lit("INVALID")).alias("kind"))
    kinds = r.groupBy(split, "kind").agg(F.count("*").alias("n")).groupBy(split).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "n"))), ",").alias("value_kinds"))  # a few kinds
    per = r.groupBy(split).agg(F.count("*").alias("n_items"), F.bool_and(F.coalesce(F.col(key).rlike("^[0-9]+$"), F.lit(False))).alias("numeric_keys"), F.min(key).alias("first_key"))
    return per.join(kinds, split)


def provenance_sizes(pairs: DataFrame) -> DataFrame:
    """Distinct ids of either side, in both, and in any."""
    ids = pairs.select(F.explode(F.array(F.struct(F.col("id").alias("x"), F.lit(1).alias("side")), F.struct(F.col("image_id").alias("x"), F.lit(2).alias("side")))).alias("c")).select("c.*").where("x IS NOT NULL")
    per = ids.groupBy("x").agg(F.bit_or("side").alias("s"))
    return per.agg(count_if(F.col("s").bitwiseAND(1) > 0).alias("caption_side_ids"), count_if(F.col("s").bitwiseAND(2) > 0).alias("image_side_ids"), count_if(F.col("s") == 3).alias("overlapping_ids"), F.count("*").alias("required_ids"))


def _shared(left: DataFrame, right: DataFrame, column: str, name: str, distinct: bool = True) -> DataFrame:
    found = left.where(F.col(column).isNotNull()).join(right.select(column).distinct(), column, "left_semi")
    return found.agg((F.count_distinct(column) if distinct else F.count("*")).alias(name))


def evidence_overlap(evidence: DataFrame, required: DataFrame, captions: DataFrame, flag: str = "is_query_provenance") -> DataFrame:
    """How far the evidence covers the required records, and what its background shares with them.

    ``evidence`` and ``required``: (id, image_path, caption, full_article_path); ``captions``: (caption) of the queries.
    """
    background = evidence.where(~F.col(flag))
    parts = [
        required.agg(F.count_distinct("id").alias("required")),
        _shared(evidence, required, "id", "covered"),
        _shared(background, required, "id", "background_ids"),
        _shared(background, required, "image_path", "background_paths"),
        _shared(background, captions, "caption", "background_captions"),
        _shared(background, required, "full_article_path", "background_article_rows", distinct=False),
    ]
    one = reduce(lambda a, b: a.crossJoin(b), parts)  # one row each
    return one.withColumns({"missing": F.col("required") - F.col("covered"), "coverage_pct": F.try_divide(F.col("covered") * 100.0, "required")})


def evidence_checks(evidence: DataFrame, required: DataFrame, captions: DataFrame, size: int, populated: list[str], flag: str = "is_query_provenance", split: str = "split", origin: str = "train") -> DataFrame:
    """V5: size, unique ids and paths, provenance whole and flagged, background apart, fields populated, background from one split."""
    o = evidence_overlap(evidence, required, captions, flag).crossJoin(evidence.agg(F.count("*").alias("rows"), count_if(F.col(flag)).alias("flagged")))
    wide = o.select(
        (F.col("rows") != size).cast("long").alias("size"), F.col("missing").alias("provenance_missing"), F.abs(F.col("flagged") - F.col("required")).alias("provenance_flags"), F.col("background_ids"), F.col("background_paths"), F.col("background_captions")
    )
    rules = {f"populated:{c}": ~P.has_text(F.col(c).cast("string")) for c in populated} | {"background_origin": ~F.col(flag) & ~F.col(split).eqNullSafe(F.lit(origin))}
    return contracts.long(wide).unionByName(contracts.unique(evidence, ["id"], ["image_path"])).unionByName(contracts.checks(evidence, rules))


def aligned(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys that one side lacks, and of each column the keys with different values (arrays and maps too)."""
    plain = lambda c, kind: F.map_entries(c) if kind.startswith("map") else F.col(c)
    side = lambda df, s: df.select(F.col(key), F.lit(True).alias(f"in_{s}"), *[(F.array_sort(plain(c, k)) if k.startswith("map") else F.col(c)).alias(f"{s}_{c}") for c, k in df.dtypes if c in columns])
    both = side(left, "a").join(side(right, "b"), key, "full")
    whole = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    return contracts.checks(both, {"only_left": F.col("in_b").isNull(), "only_right": F.col("in_a").isNull()} | {c: whole & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns})


def enrich(rows: DataFrame, details: DataFrame, key: str, one_to_one: bool = False) -> DataFrame:
    """``rows`` with their ``details``; a key that ``details`` has twice is an error, and with ``one_to_one`` one that ``rows`` has twice."""

    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        one = df.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*rest)).alias("__x"))
        x = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} comes twice: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(one.schema["__x"].dataType)).otherwise(F.col("__x"))
        return one.select(key, x.alias("__x")).select(key, "__x.*")

    return (once(rows) if one_to_one else rows).join(once(details), key, "left")


def protected_alignment(expected: DataFrame, actual: DataFrame, key: str, editable: list[str]) -> DataFrame:
    """Columns missing or extra, blank or repeated ids of either table, ids that one lacks, protected cells changed."""
    columns = [c for c in expected.columns if c not in editable]
    lost = sorted((set(expected.columns) | set(editable)) - set(actual.columns))
    extra = sorted(set(actual.columns) - set(expected.columns) - set(editable))
    spare = expected.sparkSession.createDataFrame([("missing_columns", len(lost)), ("extra_columns", len(extra))], "check string, n long")
    ids = [
        contracts.checks(t, {f"blank:{name}": ~P.has_text(F.col(key).cast("string"))}).unionByName(contracts.unique(t, [key]).select(F.lit(f"repeated:{name}").alias("check"), "n"))
        for name, t in (("expected", expected), ("actual", actual))
    ]
    both = aligned(expected, actual, key, [c for c in columns if c != key and c in actual.columns])
    return reduce(DataFrame.unionByName, [spare, *ids, both])


def label_reuse(rows: DataFrame, labelled: DataFrame | Column, pair: list[str], columns: list[str]) -> DataFrame:
    """``rows`` of any channel with the labels that their pair has; null where it has none.

    ``labelled`` is a table, or says which of ``rows`` are labelled; these are read once then.
    """
    if isinstance(labelled, DataFrame):
        return rows.join(labelled.select(*pair, *columns).dropDuplicates(pair), pair, "left")
    known = reduce(and_, [F.col(p).isNotNull() for p in pair], labelled)
    found = F.min(F.when(known, F.struct(*columns))).over(Window.partitionBy(*pair))
    return rows.withColumn("__found", found).select(*[c for c in rows.columns if c not in columns], *[F.col("__found")[c].alias(c) for c in columns])


def complete(counts: DataFrame, domain: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` over all keys of ``domain``; those that are absent count 0."""
    return domain.select(*keys).distinct().join(counts, keys, "left").na.fill(0)
