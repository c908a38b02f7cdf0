"""Document fingerprints by winnowing, with built-in functions only.

A text is lower-cased and read as tokens: runs of letters and digits, or of other signs.  Of
a run of more than ``RUN`` characters every ``RUN`` in a row are a token, so its tokens don't
depend on where it starts.  Every ``K`` tokens in a row give a hash, and of every ``W``
hashes in a row the smallest is chosen, the rightmost of equal ones.  The chosen hashes are
kept with their positions, so any two texts that share a stretch of ``W + K - 1`` tokens
share a fingerprint entry, and an entry says where.  A text of fewer than ``2 (W + K - 1)``
tokens keeps the hashes of all its 1 to ``K`` tokens in a row, so two of them share an entry if they
share a token, and one shares an entry with a longer text as above.  Likeness is the
Jaccard index of the chosen hashes (two empty sets: 1).

A chosen entry is one long: 40 bits of hash, then the complement of the token position in
24 bits, so the smallest entry of a window is the rightmost smallest hash.  Positions count
modulo 2^24.

Null texts are empty, empty texts have the empty fingerprint.  Neighbours follow descending
doc_id (nulls last, repeated ids by a hash of the text); a row alone is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 5
W = 12
RUN = 16
_RUNS = r"[\p{L}\p{N}]++|[^\p{L}\p{N}\s]++"
_LONG = r"[\p{L}\p{N}]{17}|[^\p{L}\p{N}\s]{17}"
_EACH = r"(?s)(?=(.{16}))"
_FIRST = -(1 << 63)


def _least(array: str, offsets) -> str:
    got = [f"get({array}, i + {j})" for j in offsets]
    return f"least({', '.join(got)})" if len(got) > 1 else got[0]


def with_entries(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``df`` with ``out array<long>``: the entries chosen from the column ``text``, in order of position."""
    h, g, m = f"__h_{out}", f"__g_{out}", f"__m_{out}"
    step = -(-w // 3)  # minima of a window from those of its three overlapping parts
    starts = sorted({0, step, w - step} if w > 2 else {0, w - step})
    gram = lambda n: f"transform(sequence(0, size({h}) - {n}), i -> (xxhash64({', '.join(f'get({h}, i + {j})' for j in range(n))}) & -16777216L) | (16777215L - i % 16777216))"
    every = f"concat({', '.join(f'CASE WHEN size({h}) < {n} THEN cast(array() AS array<bigint>) ELSE {gram(n)} END' for n in range(1, k + 1))})"
    runs = f"regexp_extract_all(lower({text}), r'{_RUNS}', 0)"
    rolled = f"flatten(transform({runs}, x -> CASE WHEN char_length(x) > {RUN} THEN regexp_extract_all(x, r'{_EACH}', 1) ELSE array(x) END))"
    tokens = f"CASE WHEN lower({text}) rlike r'{_LONG}' THEN {rolled} ELSE {runs} END"
    short = f"size({h}) < {2 * (w + k - 1)}"
    parts = f"transform(sequence(0, size({g}) - {step}), i -> {_least(g, range(step))})"
    least = f"transform(sequence(0, size({g}) - {w}), i -> {_least(m, starts)})"
    return (
        df.withColumn(h, F.expr(f"transform({tokens}, x -> xxhash64(x))"))
        .withColumn(g, F.expr(f"CASE WHEN {short} THEN {every} ELSE {gram(k)} END"))
        .withColumn(m, F.expr(f"CASE WHEN {short} THEN {g} ELSE {parts} END"))
        .withColumn(out, F.expr(f"CASE WHEN {short} THEN {g} ELSE array_distinct({least}) END"))
        .drop(h, g, m)
    )


def printed(entries: str) -> Column:
    """Entries as ``hash@position`` in hexadecimal, joined by blanks."""
    return F.expr(f"array_join(transform({entries}, e -> concat(hex(shiftrightunsigned(e, 24)), '@', hex(16777215L - (e & 16777215L)))), ' ')")


def hashes(entries: str) -> Column:
    """The distinct hashes of an entry array."""
    return F.expr(f"array_distinct(transform({entries}, e -> shiftrightunsigned(e, 24)))")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the Jaccard index of two columns of distinct hashes."""
    both = f"__i_{out}"
    df = df.withColumn(both, F.size(F.array_intersect(a, b)))
    union = F.size(a) + F.size(b) - F.col(both)
    return df.withColumn(out, F.when(union == 0, 1.0).otherwise(F.col(both).cast("double") / union)).drop(both)


def with_next(rows: DataFrame, key: str, tie: str, text: str, carried: list[str], prepared=lambda df: df) -> DataFrame:
    """``prepared(rows)`` with ``next_<c>`` for each carried column: its value in the row that follows by descending ``key``.

    ``prepared`` adds columns row by row, from ``key``, ``tie`` and ``text``.

    Rows are dealt to ranges of ``key`` by its quantiles; the first row of each range is also sent
    to the range before it, so no task sees more than its range.
    """
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted({int(x) for x in rows.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    cut_list = f"array({', '.join(f'{c}L' if c > _FIRST else f'(-{-(c + 1)}L - 1L)' for c in cuts)})"
    bucket = F.expr(f"size(filter({cut_list}, c -> c <= {key}))") if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    tops = sorted((r["bucket"], r["top"]) for r in rows.groupBy("bucket").agg(F.max(key).alias("top")).collect())  # one row a range
    if not tops:
        return prepared(rows.drop("bucket")).withColumns({f"next_{c}": F.col(c) for c in carried})
    above = [b for b, _ in tops[1:]] + [tops[0][0]]
    where = spark.createDataFrame([(top, to) for (_, top), to in zip(tops, above, strict=True)], f"{key} long, to int")
    guests = rows.drop("bucket").join(F.broadcast(where), key).groupBy(key, "to").agg(F.max(F.struct(tie, text)).alias("g"))
    guests = guests.select(key, F.col("to").alias("bucket"), F.lit(1).alias("guest"), *[F.col(f"g.{c}").alias(c) for c in (tie, text)])
    w = Window.partitionBy("bucket").orderBy("guest", F.desc(key), F.desc(tie))
    both = prepared(rows.withColumn("guest", F.lit(0))).unionByName(prepared(guests), allowMissingColumns=True)
    return both.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("guest = 0").drop("guest", "bucket")


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("tie", F.xxhash64("text")), "key", "tie", "text", ["text", "own"], lambda df: with_entries(df, "text", "own"))
    rows = rows.withColumn("n", F.char_length("text").cast("long")).withColumn("cut", F.expr("cast(n div 3 AS int)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n AS int) - cut), substring(next_text, 1, cut))"))
    rows = with_entries(rows.select("key", "n", "edited", "own", "next_own"), "edited", "new")
    rows = rows.withColumns({"own_hashes": hashes("own"), "new_hashes": hashes("new"), "next_hashes": hashes("next_own")})
    rows = with_likeness(with_likeness(rows, "own_hashes", "new_hashes", "near_edited"), "own_hashes", "next_hashes", "near_next")
    return rows.select(
        F.when(F.col("key") > _FIRST, F.col("key")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("own").alias("fingerprint"),
        printed("new").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
