"""Row predicates and scalar rules, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_class(v: Column) -> Column:
    """Label of a variant that must be a true boolean."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "falsified").otherwise("pristine")).otherwise("INVALID_OR_MISSING")


def class_label(falsified: Column) -> Column:
    return F.when(falsified.isNull(), "INVALID_OR_MISSING").when(falsified, "falsified").otherwise("pristine")


def strict_id(v: Column) -> Column:
    """A variant that is an integer of at least 0; a boolean or 1.0 isn't."""
    return F.coalesce((F.schema_of_variant(v) == "BIGINT") & (F.try_variant_get(v, "$", "bigint") >= 0), F.lit(False))


def valid_id(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def has_text(c: Column) -> Column:
    """Holds a character that isn't white space of any script (nor one of U+001C to U+001F)."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def named(names: Column, key: Column, unknown: str = "UNKNOWN_OR_INVALID") -> Column:
    """The name that the map ``names`` has for ``key``."""
    return F.coalesce(F.try_element_at(names, key.cast("string")), F.lit(unknown))


def malformed_path(p: Column) -> Column:
    """Absolute, climbing, with a backslash or NUL, or without suffix; a blank path isn't called malformed."""
    leaf = F.element_at(F.split(p, "/"), -1)
    bad = p.startswith("/") | F.array_contains(F.split(p, "/"), "..") | p.contains("\\") | p.contains("\0") | ~leaf.rlike(r"^.+\.[^.]+$")
    return F.when(~has_text(p), False).otherwise(bad)


def unsafe_path_reason(p: Column) -> Column:
    """Why a relative path isn't safe; null if it is."""
    parts = F.split(p, "/")
    return (
        F.when(p.isNull() | (p == ""), "empty")
        .when(p.contains("\\"), "backslash")
        .when(p.rlike(r"[\x00-\x1f]"), "control character")
        .when(p.startswith("/"), "absolute")
        .when(F.exists(parts, lambda x: x.isin("", ".", "..")), "empty or dotted part")
        .when(F.get(parts, F.lit(0)).contains(":"), "drive or scheme")
    )


def asset_path_ok(p: Column, root: str, publishers: list[str], suffix: str = "jpg") -> Column:
    """``root``/publisher/images/dir/file.suffix with one of the publishers."""
    return F.coalesce(p.rlike(rf"^{root}/({'|'.join(publishers)})/images/[^/]+/[^/]+\.{suffix}$") & unsafe_path_reason(p).isNull(), F.lit(False))


def path_part(p: Column, i: int) -> Column:
    return F.get(F.split(p, "/"), F.lit(i))


def path_prefix(p: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(p, "/"), 1, n), "/")


def suffix_of(p: Column) -> Column:
    """Lower-case suffix with its dot, or an empty string."""
    return F.lower(F.regexp_extract(p, r"[^/](\.[^./]+)$", 1))


def role(a: Column, b: Column, both: str, first: str, second: str, neither: str | None = None) -> Column:
    return F.when(a & b, both).when(a, first).when(b, second).otherwise(F.lit(neither))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 85, "HIGH").when(score >= 70, "MEDIUM").when(score.isNotNull(), "LOW")


def whole_score(text: Column) -> Column:
    """The integer 0 to 100 that ``text`` spells without leading zeros, else null."""
    return F.when(text.rlike("^(0|[1-9][0-9]?|100)$"), text.cast("int"))


def flag(text: Column) -> Column:
    """'True' and 'False' in any case; other text is null."""
    t = F.lower(F.trim(text))
    return F.when(t == "true", True).when(t == "false", False)


def member_name(p: Column) -> Column:
    """An archive member's name without leading ``./``."""
    return F.regexp_replace(p, r"^(\./)+", "")


def requested_member(p: Column, strip: str = "", prefix: str = "") -> Column:
    """The archive name asked for: ``strip`` taken off the front, ``prefix`` put before."""
    short = F.when(p.startswith(strip), F.substring(p, len(strip) + 1, 1 << 30)).otherwise(p) if strip else p
    return F.concat(F.lit(prefix), short)


def trivial(exact: Column, linked: Column) -> Column:
    return F.coalesce(exact, F.lit(False)) | F.coalesce(linked, F.lit(False))


def uncertain(status: Column, needs_review: Column) -> Column:
    return F.coalesce(status == "REVIEW", F.lit(False)) | F.coalesce(needs_review, F.lit(False))


def visual_group(group: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(group, F.lit("")), path)


def numbered(prefix: str, n: Column, width: int = 4) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def forbidden_columns(columns: list[str], forbidden: list[str]) -> list[str]:
    return sorted(set(columns) & set(forbidden))


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return reduce(lambda at, r: at.when(r[0], r[1]), rules[1:], F.when(rules[0][0], rules[0][1]))


def norm(v: Column) -> Column:
    """L2 norm of a vector, summed in doubles."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """``v`` scaled to length 1; null where that can't be."""
    n = norm(v)
    return F.when(finite(n) & (n > 0), F.transform(v, lambda x: x.cast("double") / n))


def text_timestamp(c: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy")) -> Column:
    """A text in any of the formats, or ISO, as a timestamp; null otherwise."""
    return F.coalesce(F.try_to_timestamp(c), *[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def canonical_json(c: Column) -> Column:
    """JSON of a map with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def search_url(base: str, text: Column) -> Column:
    return F.concat(F.lit(base), F.url_encode(text))
