"""Candidate unions, label workflow, and the analysis of event labels by view, channel, rank and depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators.audit import count_if

LABELS = ("SAME", "RELATED", "IRRELEVANT")


def candidate_union(first: DataFrame, second: DataFrame, anchors: DataFrame, k: int, query: str = "qid", evidence: str = "cid") -> DataFrame:
    """The first k of two channels merged by (query, evidence), with anchors that neither has."""
    a = first.where(F.col("rank") <= k).select(query, evidence, F.col("rank").alias("rank_a"), F.col("similarity").alias("similarity_a"))
    b = second.where(F.col("rank") <= k).select(query, evidence, F.col("rank").alias("rank_b"), F.col("similarity").alias("similarity_b"))
    both = a.join(b, [query, evidence], "full")
    marked = both.join(anchors.select(query, evidence, F.lit(True).alias("is_anchor")).distinct(), [query, evidence], "full")
    retrieved = F.col("rank_a").isNotNull() | F.col("rank_b").isNotNull()
    return marked.select(query, evidence, "rank_a", "rank_b", "similarity_a", "similarity_b", F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"), (~retrieved).alias("anchor_only"))


def workload(candidates: DataFrame, query: str = "qid") -> DataFrame:
    """Candidates of each query, and those retrieved."""
    per = candidates.groupBy(query).agg(F.count("*").alias("n"), count_if(~F.col("anchor_only")).alias("r"))
    return per.agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_candidates"), F.avg("n").alias("mean_candidates"), F.min("n").alias("min_candidates"), F.max("n").alias("max_candidates"), F.avg("r").alias("mean_retrieved"))


def event_label(a: Column, b: Column) -> Column:
    """Label of two categories: equal, neighbours, else."""
    return F.when(a == b, "SAME").when(F.abs(a - b) == 1, "RELATED").otherwise("IRRELEVANT")


def event_rates(rows: DataFrame, by: list[str], label: str = "event_label") -> DataFrame:
    """Counts and rates of labels; a rate of no rows is null."""
    c = F.col(label)
    n = {x: count_if(c == x) for x in LABELS}
    relevant = count_if(c.isin("SAME", "RELATED"))
    rate = lambda x: F.try_divide(x.cast("double"), F.count("*"))
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), *[n[x].alias(f"n_{x.lower()}") for x in LABELS], relevant.alias("n_relevant"), *[rate(n[x]).alias(f"{x.lower()}_rate") for x in LABELS], rate(relevant).alias("relevant_rate"))


def views(rows: DataFrame, exact: str, linked: str, group: str, path: str, query: str = "qid", channel: str = "channel") -> DataFrame:
    """The inclusive view, and the primary one without trivial rows and later visual duplicates; ranks stay.

    Both views come of one pass over ``rows``: a row is repeated for each view that it is in.
    """
    base = rows.where(~F.coalesce("anchor_only", F.lit(False))) if "anchor_only" in rows.columns else rows
    marked = suppressed(base, exact, linked, group, path, query, channel)
    both = F.when(F.col("__trivial") | F.col("is_later_duplicate"), F.array(F.lit("inclusive"))).otherwise(F.array(F.lit("inclusive"), F.lit("primary")))
    return marked.select(*base.columns, F.explode(both).alias("view"))


def suppressed(rows: DataFrame, exact: str, linked: str, group: str, path: str, query: str = "qid", channel: str = "channel") -> DataFrame:
    """``rows`` with is_later_duplicate, true for rows whose visual group an earlier row of the query and channel shows."""
    marked = rows.withColumn("__trivial", P.trivial(F.col(exact), F.col(linked))).withColumn("__visual", P.visual_group(F.col(group), F.col(path)))
    w = Window.partitionBy(channel, query, "__trivial", "__visual").orderBy("rank", "cid")
    return marked.withColumn("is_later_duplicate", ~F.col("__trivial") & (F.row_number().over(w) > 1)).drop("__visual")


def subsets(rows: DataFrame, status: str = "review_status", needs_review: str = "needs_review") -> DataFrame:
    """Every row as part of all reviewed rows, and those that aren't uncertain a second time."""
    both = F.when(P.uncertain(F.col(status), F.col(needs_review)), F.array(F.lit("all_deep_reviewed"))).otherwise(F.array(F.lit("all_deep_reviewed"), F.lit("exclude_review")))
    return rows.withColumn("subset", F.explode(both))


def exclusions(rows: DataFrame, exact: str, linked: str, group: str, path: str, query: str = "qid", channel: str = "channel") -> DataFrame:
    """Rows of each channel, those trivial, those that repeat a visual group, those left."""
    t = P.trivial(F.col(exact), F.col(linked))
    marked = rows.withColumn("t", t).withColumn("visual", P.visual_group(F.col(group), F.col(path)))
    w = Window.partitionBy(channel, query, "t", "visual").orderBy("rank", "cid")
    marked = marked.withColumn("place", F.row_number().over(w))
    return marked.groupBy(channel).agg(F.count("*").alias("n_rows"), count_if(F.col("t")).alias("n_trivial"), count_if(~F.col("t") & (F.col("place") > 1)).alias("n_visual_repeats"), count_if(~F.col("t") & (F.col("place") == 1)).alias("n_kept"))


def rank_rates(rows: DataFrame, cohort: int | Column, depth: int, query: str = "qid", label: str = "event_label", channel: str = "channel") -> DataFrame:
    """At each rank, label rates of that rank and up to it, and queries with a hit over the fixed cohort."""
    ranks = F.explode(F.sequence(F.col("rank").cast("int"), F.lit(depth)))
    at = rows.where(F.col("rank").between(1, depth)).withColumn("k", ranks)
    c, here = F.col(label), F.col("rank") == F.col("k")
    size = F.lit(cohort) if isinstance(cohort, int) else cohort
    ratio = lambda a, b: F.try_divide(a.cast("double"), b)
    return at.groupBy(channel, "k").agg(
        count_if(here).alias("n_rank"), ratio(count_if(here & (c == "SAME")), count_if(here)).alias("same_at_rank"), F.count("*").alias("n_up_to"), ratio(count_if(c == "SAME"), F.count("*")).alias("same_up_to"), ratio(F.count_distinct(F.when(c == "SAME", F.col(query))), size).alias("query_hit_rate")
    )


def similarity_by_label(rows: DataFrame, by: list[str], label: str = "event_label", similarity: str = "similarity") -> DataFrame:
    """Mean, median, sample deviation (null for one row) and bounds.

    Medians are exact.  A group's scores are packed by steps of 1/10,000 where they are dealt out, so
    that a group's task reads packed scores and sorts only those of the steps that hold its middle.
    """
    keys, s, c = [*by, label], F.col(similarity).cast("double"), F.col
    step = F.when(F.isnan(s), F.lit((1 << 63) - 1)).otherwise(F.floor(s * 10_000))  # never falls as scores rise
    packed = rows.groupBy(*keys, step.alias("__step")).agg(F.count("*").alias("__rows"), F.count(s).alias("__n"), F.avg(s).alias("__mean"), F.var_pop(s).alias("__var"), F.min(similarity).alias("__min"), F.max(similarity).alias("__max"), F.collect_list(s).alias("__scores"))
    group = Window.partitionBy(*keys)
    before = F.sum("__n").over(group.orderBy("__step").rowsBetween(Window.unboundedPreceding, -1))
    placed = packed.withColumns({"__before": F.coalesce(before, F.lit(0)), "__all": F.sum("__n").over(group), "__sum": F.sum(c("__n") * c("__mean")).over(group)}).withColumn("__avg", F.try_divide("__sum", "__all"))
    low, high = F.floor((c("__all") - 1) / 2) - c("__before"), F.floor(c("__all") / 2) - c("__before")
    placed = placed.withColumn("__sorted", F.when((high >= 0) & (low < c("__n")), F.sort_array("__scores")))
    at = lambda i: F.max(F.when((i >= 0) & (i < c("__n")), F.get("__sorted", i.cast("int"))))
    off = F.sum(c("__n") * (c("__var") + F.pow(c("__mean") - c("__avg"), 2)))
    return placed.groupBy(*keys).agg(
        F.sum("__rows").alias("n_rows"), F.first("__avg").alias("mean_sim"), (at(low) * 0.5 + at(high) * 0.5).alias("median_sim"), F.when(F.first("__all") > 1, F.sqrt(F.try_divide(off, F.first("__all") - 1))).alias("std_sim"), F.min("__min").alias("min_sim"), F.max("__max").alias("max_sim")
    )


def upper_quartile(rows: DataFrame, by: list[str], label: str = "event_label", similarity: str = "similarity") -> DataFrame:
    """Labels among rows at or above the linear 0.75 quantile."""
    cut = rows.groupBy(*by).agg(F.percentile(similarity, F.lit(0.75)).alias("threshold"))
    top = rows.join(F.broadcast(cut), by)  # one row for each combination of a channel's few keys
    return top.where(F.col(similarity) >= F.col("threshold")).groupBy(*by, label).agg(F.first("threshold").alias("threshold"), F.count("*").alias("n_rows"))


def above_sole_positive(rows: DataFrame, by: list[str], label: str = "event_label", similarity: str = "similarity") -> DataFrame:
    """Rows above the score of a group's only SAME row; null unless there is exactly one."""
    w = Window.partitionBy(*by)
    same = F.col(label) == "SAME"
    marked = rows.withColumns({"n_same": F.sum(same.cast("int")).over(w), "sole": F.max(F.when(same, F.col(similarity))).over(w)})
    return marked.groupBy(*by).agg(F.first("n_same").cast("long").alias("n_same"), F.when(F.first("n_same") == 1, count_if(~same & (F.col(similarity) > F.col("sole")))).alias("n_above"))


def confidence_summary(rows: DataFrame, score: str = "confidence_score") -> DataFrame:
    """Rows by level, and by bin of the score, with the bins' bounds of scores."""
    s = F.col(score)
    bins = F.when(s >= 95, ">=95").when(s >= 85, "85-94").when(s >= 70, "70-84").otherwise("<70")
    kinds = F.array(F.struct(F.lit("level").alias("kind"), P.confidence_band(s).alias("value")), F.struct(F.lit("bin").alias("kind"), bins.alias("value")))
    return rows.where(s.isNotNull()).select(s.alias("s"), F.explode(kinds).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), F.avg("s").alias("mean"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose two labels agree."""
    return rows.agg(F.count("*").alias("n_rows"), F.avg(F.coalesce(F.col(a) == F.col(b), F.lit(False)).cast("int")).alias("agreement"))


def sensitivity(rates: DataFrame, key: list[str], kind: str, base: str, other: str, rate: str) -> DataFrame:
    """A rate under two views side by side, and the change in percentage points."""
    wide = rates.groupBy(*key).pivot(kind, [base, other]).agg(F.max(rate))
    return wide.withColumn("delta_points", (F.col(other) - F.col(base)) * 100)


def first_rank(rows: DataFrame, positive: Column, query: str = "qid", channel: str = "channel") -> DataFrame:
    """The first rank of a query and channel that is positive; null if there is none."""
    return rows.groupBy(query, channel).agg(F.min(F.when(positive, F.col("rank"))).alias("first_rank"), F.max("rank").alias("max_depth"))


def coverage_by_depth(first: DataFrame, depths: list[int], query: str = "qid", channel: str = "channel") -> DataFrame:
    """Queries with a positive up to each depth, by channel and over all channels."""
    scopes, at = F.explode(F.array(F.col(channel), F.lit("union"))), F.explode(F.array(*[F.lit(d) for d in depths]))
    best = first.select(query, "first_rank", scopes.alias("scope")).groupBy(query, "scope").agg(F.min("first_rank").alias("best"))
    n, hit = F.count(query), F.count(F.when(F.col("best") <= F.col("depth"), F.col(query)))
    return best.select("*", at.alias("depth")).groupBy("scope", "depth").agg(n.alias("n_queries"), hit.alias("n_covered"), (hit.cast("double") / n).alias("rate"))


def first_rank_stats(first: DataFrame, query: str = "qid", channel: str = "channel") -> DataFrame:
    """Bounds and median of first ranks, by channel and of each query's best; ``first`` is read once."""
    scope = lambda name, rank: F.struct(name.alias("scope"), rank.alias("first_rank"))
    per = first.groupBy(query).agg(F.collect_list(scope(F.col(channel), F.col("first_rank"))).alias("each"), F.min("first_rank").alias("best"))  # a query has few channels
    both = per.select(F.explode(F.concat("each", F.array(scope(F.lit("union"), F.col("best"))))).alias("x")).select("x.*")
    return both.where("first_rank IS NOT NULL").groupBy("scope").agg(F.count("*").alias("n"), F.min("first_rank").alias("best"), F.median("first_rank").alias("median"), F.max("first_rank").alias("worst"))


def reviewed_prefix(rows: DataFrame, reviewed: str, query: str = "qid", channel: str = "channel") -> DataFrame:
    """How many ranks from the first on are reviewed without a gap."""
    return rows.groupBy(query, channel).agg(F.coalesce(F.min(F.when(~F.col(reviewed), F.col("rank"))) - 1, F.max("rank")).alias("prefix"))


def review_queue(rows: DataFrame, status: str, band: str, key: str) -> DataFrame:
    """Low confidence first, then rows under review, medium, the rest; then by id."""
    order = F.when(F.col(band) == "LOW", 0).when(F.col(status) == "REVIEW", 1).when(F.col(band) == "MEDIUM", 2).otherwise(3)
    return rows.withColumn("priority", order).orderBy("priority", key)


def deep_queue(rows: DataFrame, score: str, key: str) -> DataFrame:
    """Rows without a score first, then by ascending score."""
    return rows.orderBy(F.col(score).asc_nulls_first(), key)


def numbered_in_order(rows: DataFrame, first: str, key: str, values: int) -> DataFrame:
    """``rows`` with their place, from 0, by ``first`` (nulls first) and ``key``; ``first`` has few values (at most ``values``), so places come of counts by value and of ranks within."""
    counts = rows.groupBy(first).agg(F.count("*").alias("__n"))
    w = Window.orderBy(F.col(first).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # ``values`` rows
    starts = counts.select(F.col(first).alias("__f"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__start"))
    placed = rows.join(F.broadcast(starts.limit(values)), F.col(first).eqNullSafe(F.col("__f")))
    return placed.select(*rows.columns, (F.col("__start") + F.row_number().over(Window.partitionBy(first).orderBy(key)) - 1).cast("long").alias("place"))


def next_batch(rows: DataFrame, pending: Column, query: str, place: str, n: int) -> DataFrame:
    """The first n queries, by first appearance, that still have pending rows."""
    return rows.where(pending).groupBy(query).agg(F.min(place).alias("first")).orderBy("first", query).limit(n)


def apply_updates(rows: DataFrame, proposals: DataFrame, key: str, columns: list[str], pending: Column) -> DataFrame:
    """Proposals fill pending rows only; a second proposal for a key is an error, others are ignored."""
    one = proposals.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(f"__{c}") for c in columns])
    both = rows.join(one, key, "left")
    hit = pending & F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("two proposals for "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("__n") == 1)
    return both.select(*[F.when(F.coalesce(hit, F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def review_status(old: Column, new: Column, score: Column, flagged: Column) -> Column:
    """REVIEW if the label changed, confidence is low or a flag is set; else LABELED."""
    return F.when(F.coalesce(old != new, F.lit(False)) | F.coalesce(score < 85, F.lit(True)) | F.coalesce(flagged, F.lit(False)), "REVIEW").otherwise("LABELED")


def changes(old: DataFrame, new: DataFrame, key: str, label: str) -> DataFrame:
    """Rows whose label differs between two states."""
    return old.select(key, F.col(label).alias("old_label")).join(new.select(key, F.col(label).alias("new_label")), key).where(~F.col("old_label").eqNullSafe(F.col("new_label")))


def high_audit(rows: DataFrame, changed: DataFrame, key: str, label: str, band: str, n: int, seed: int) -> DataFrame:
    """The audited rows of HIGH confidence, ``n`` of each label in hash order, with the label they had before, if it changed."""
    from evidrill.operators.sampling import per_group

    drawn = per_group(rows.where(F.col(band) == "HIGH"), [label], key, n, seed)
    return drawn.join(changed.select(key, "old_label"), key, "left").withColumn("was_changed", F.col("old_label").isNotNull())


def progress(rows: DataFrame, status: str) -> DataFrame:
    """Rows labelled, under review, and open."""
    s = F.col(status)
    return rows.agg(F.count("*").alias("n_rows"), count_if(s == "LABELED").alias("n_labeled"), count_if(s == "REVIEW").alias("n_review"), count_if(s.isNull() | s.isin("", "UNLABELED")).alias("n_open"))


def readiness(violations: DataFrame, progressed: DataFrame) -> DataFrame:
    """READY if nothing is open and no contract is violated."""
    v = violations.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))
    return progressed.crossJoin(v).select("*", F.when(F.col("violations") > 0, "BLOCKED").when(F.col("n_open") > 0, "INCOMPLETE").when(F.col("n_review") > 0, "NEEDS_REVIEW").otherwise("READY").alias("decision"))
