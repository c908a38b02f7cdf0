"""Exact inner-product retrieval on several channels, with raw and filtered ranks, and its metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions import predicates as P
from evidrill.operators.audit import count_if

#: Queries of a task at most, as many more as fewer than DEPTH of each are kept, up to MOST (``_ranked`` is
#: faster below 2^16), and vectors of either side in one product.
QUERIES, DEPTH, MOST, BLOCK = 24_576, 52, 57_344, 512
#: The last rank that ``score_summary`` reads.
SUMMARY = 10
#: Candidates that give the first floors; pairs held between two scorings, and scored at once.
FIRST, HELD, PAIRS = 8_192, 1 << 21, 1 << 10


def vector_contract(vectors: DataFrame, vec: str, tolerance: float = 1e-5) -> DataFrame:
    """Length statistics, and vectors that aren't finite or of length 1."""
    v = vectors.select(vec, P.norm(F.col(vec)).alias("n"), F.exists(vec, lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True))).alias("bad"))
    return v.agg(F.count("*").alias("n_vectors"), F.min("n").alias("min_norm"), F.avg("n").alias("mean_norm"), F.max("n").alias("max_norm"), count_if(F.col("bad") | F.col(vec).isNull()).alias("n_not_finite"), count_if(F.abs(F.col("n") - 1) > tolerance).alias("n_not_unit"))


def topk_inner_product(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "qid", cid: str = "cid", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(qid, cid, similarity, raw_rank), ties to the smaller cid.

    Every query meets every vector.  A task holds a part of the queries with their k best, and the
    corpus streams by in batches, so no side is broadcast or whole in one place, and only the k best
    leave a task.  Every part has the corpus sent to it, so there are as few as the k best allow.
    Of equal vectors the k with the smallest cids take part: no others can be among the k best.  The
    corpus goes by in hash order, so that few candidates pass for a while only.
    """
    q, c = queries.select(F.col(qid).alias("qid"), F.col(vec).alias("v")), corpus.select(F.col(cid).alias("cid"), F.col(vec).alias("v"))
    n, cores = q.count(), q.sparkSession.sparkContext.defaultParallelism
    held = min(MOST, max(QUERIES, QUERIES * DEPTH // max(k, 1)))
    parts = max(1, min(-(-n // block), cores * -(-n // (held * cores))))
    w = Window.partitionBy(F.xxhash64("v"), "v").orderBy("cid")
    c = c.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k)
    kinds = dict(q.dtypes) | dict(c.dtypes)
    asked = q.select(F.pmod(F.xxhash64("qid"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("side"), F.xxhash64("qid").alias("at"), "qid", F.lit(None).cast(kinds["cid"]).alias("cid"), "v")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    found = c.select(every.alias("part"), F.lit(1).alias("side"), F.xxhash64("cid").alias("at"), F.lit(None).cast(kinds["qid"]).alias("qid"), "cid", "v")
    dealt = asked.unionByName(found).repartitionById(parts, "part").sortWithinPartitions("side", "at").select("side", "qid", "cid", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, best = [], [], None
        for b in batches:
            side = b.column(0).to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(side, 1))
            if split:
                ids.append(_ids(b.column(1)[:split]))
                vectors.append(_matrix(b.column(3)[:split]))
            if split < len(side) and ids:
                best = best or Best(np.concatenate(ids), _stacked(vectors), k, block)
                best.meet(_ids(b.column(2)[split:]), _matrix(b.column(3)[split:]))
        if best is None:
            return
        names, types = ["qid", "cid", "similarity", "raw_rank"], [b.schema.field(1).type, b.schema.field(2).type, pa.float64(), pa.int32()]
        columns = best.result()
        for a in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)], t) for x, t in zip(columns, types, strict=True)], names=names)

    return dealt.mapInArrow(run, f"qid {kinds['qid']}, cid {kinds['cid']}, similarity double, raw_rank int")


def _ids(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("an id is null")
    return column.to_numpy(zero_copy_only=False)


def _matrix(column: pa.Array) -> np.ndarray:
    ends = column.offsets.to_numpy()
    widths = np.diff(ends)
    flat = column.flatten()
    if column.null_count or flat.null_count or (widths != widths[0]).any():
        raise ValueError("a vector is null, holds null or differs in its number of components")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _stacked(parts: list[np.ndarray]) -> np.ndarray:
    if len({x.shape[1] for x in parts}) > 1:
        raise ValueError("vectors differ in their number of components")
    return np.concatenate(parts)


class Best:
    """The k best candidates of some queries, as candidates come by.

    Products in single precision only pass candidates over: those whose product, with the most that
    rounding can take from it, stays below the k-th score so far.  All others are scored term by
    term in double precision, so sums are those of a fold.  Where single precision may overflow, or
    a vector isn't finite, nothing is passed over.  NaN is above all numbers, as in SQL.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, block: int):
        self.ids, self.exact, self.k, self.block = ids, vectors, k, block
        with np.errstate(over="ignore", invalid="ignore"):
            self.single, self.norm = vectors.astype(np.float32), _norms(vectors)
        self.floor = np.full(len(ids), -np.inf)  # at most the k-th score
        self.rows, self.scores, self.found = np.empty(0, np.int64), np.empty(0), None
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.fresh = 0, True

    def _slack(self, norm: np.ndarray, most: float) -> np.ndarray:
        """What rounding can add to a product or take from it."""
        dim = self.exact.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            size = norm * most
            slack = (dim + 8) * 2.0**-24 * size + dim * 2e-38 * (1 + norm + most)
        return np.where((size < 1e37) & (norm < 1e37) & (most < 1e37), slack, np.inf)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] != self.exact.shape[1]:
            raise ValueError("vectors differ in their number of components")
        with np.errstate(over="ignore", invalid="ignore"):
            single, norm = vectors.astype(np.float32), _norms(vectors)
            if self.fresh and len(ids) > self.k:
                self._first(single[:FIRST], norm[:FIRST].max())
            self.fresh = False
            held, hits = 0, []
            n, step = len(self.ids), self.block
            buffer, below = np.empty(step * step, np.float32), np.empty(step * step, bool)
            for c in range(0, len(ids), step):
                side, floor = np.ascontiguousarray(single[c : c + step].T), None
                width, most = side.shape[1], norm[c : c + step].max()
                for q in range(0, n, step):
                    if floor is None:
                        floor = np.nextafter((self.floor - self._slack(self.norm, most)).astype(np.float32), np.float32(-np.inf))[:, None]
                    some = self.single[q : q + step]
                    product, low = (x[: len(some) * width].reshape(len(some), width) for x in (buffer, below))
                    np.matmul(some, side, out=product)
                    np.less(product, floor[q : q + step], out=low)
                    at = _not_set(below[: len(some) * width])
                    if len(at):
                        row, col = np.divmod(at, width)
                        hits.append((row + q, col + c))
                        held += len(at)
                    if held > HELD:
                        self._score(hits, ids, vectors)
                        held, hits, floor = 0, [], None
            if hits:
                self._score(hits, ids, vectors)

    def _first(self, single: np.ndarray, most: float) -> None:
        """Floors that k of the first candidates reach."""
        slack, k, side = self._slack(self.norm, most), self.k, np.ascontiguousarray(single.T)
        if len(single) < k:
            return
        step = max(1, min(self.block, (1 << 22) // len(single)))
        for q in range(0, len(self.ids), step):
            kth = np.partition(self.single[q : q + step] @ side, len(single) - k, axis=1)[:, len(single) - k]
            ok = np.isfinite(kth) & np.isfinite(slack[q : q + step])
            self.floor[q : q + step] = np.where(ok, kth - slack[q : q + step], -np.inf)

    def _score(self, hits: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, vectors: np.ndarray) -> None:
        rows, cols = (np.concatenate(x) for x in zip(*hits, strict=True))
        for a in range(0, len(rows), PAIRS):
            r, c = rows[a : a + PAIRS], cols[a : a + PAIRS]
            score = _folded(self.exact[r], vectors[c])
            keep = ~(score < self.floor[r])
            self.pending.append((r[keep], score[keep], ids[c[keep]]))
            self.waiting += len(self.pending[-1][0])
        if self.waiting >= min(len(self.ids) * self.k // 4, HELD):
            self._settle()

    def _settle(self) -> None:
        if not self.pending:
            return
        old = [] if self.found is None else [(self.rows, self.scores, self.found)]
        rows, scores, found = (np.concatenate(x) for x in zip(*old, *self.pending, strict=True))
        self.pending, self.waiting = [], 0
        rank, (self.rows, self.scores, self.found) = _ranked(rows, scores, found, self.k)
        last = rank == self.k
        self.floor[self.rows[last]] = self.scores[last]

    def result(self) -> tuple[np.ndarray, ...]:
        """(qid, cid, similarity, rank); rows that share a qid are one query."""
        self._settle()
        if self.found is None:
            return np.empty(0, self.ids.dtype), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int32)
        names, of = np.unique(self.ids, return_inverse=True)
        rank, (rows, scores, found) = _ranked(of[self.rows], self.scores, self.found, self.k)
        return names[rows], found, scores, rank.astype(np.int32)


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, term by term from the first on, as a fold; a sum along a row goes in another order."""
    if len(a) < 2:
        return np.cumsum(np.multiply(a, b, dtype=np.float64), axis=1)[:, -1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    return np.add.reduce(np.multiply(a, b, dtype=np.float64), axis=0)  # row is added to row


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths; infinite where they aren't numbers."""
    n = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return np.where(np.isnan(n), np.inf, n)


def _not_set(flags: np.ndarray) -> np.ndarray:
    """The places of False in contiguous flags that are mostly True; eight are looked at at once."""
    if len(flags) % 8:
        return np.flatnonzero(~flags)
    words = np.flatnonzero(flags.view(np.uint64) != 0x0101010101010101)
    word, byte = np.nonzero(~flags.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def _ranked(rows: np.ndarray, scores: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best of each row by descending score, then id, with their ranks from 1; in order of rows."""
    if len(rows) and rows.max() < 1 << 16 and np.isfinite(scores).all():
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        rows, scores, found = rows[order], scores[order], found[order]
        n = np.bincount(rows)
        start, width = np.cumsum(n) - n, n.max()
        if len(n) * width <= 4 * len(rows) + (1 << 20):
            wide = np.full((len(n), width), np.inf)
            wide[rows, np.arange(len(rows)) - start[rows]] = -scores
            at = np.argsort(wide, axis=1)
            top = np.take_along_axis(wide, at[:, : k + 1], 1)
            if not ((top[:, 1:] == top[:, :-1]) & np.isfinite(top[:, 1:])).any():
                row, place = np.nonzero(np.arange(min(k, width)) < n[:, None])
                take = start[row] + at[row, place]
                return place + 1, (row, scores[take], found[take])
    nan = np.isnan(scores)
    order = np.lexsort((found, np.where(nan, 0, -scores), ~nan, rows) if nan.any() else (found, -scores, rows))
    rows, scores, found = rows[order], scores[order], found[order]
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.empty(0, np.int64)
    rank = np.arange(1, len(rows) + 1) - np.repeat(start, np.diff(np.r_[start, len(rows)]))
    keep = rank <= k
    return rank[keep], (rows[keep], scores[keep], found[keep])


def pool_size(queries: DataFrame, corpus: DataFrame, text: str, k: int) -> DataFrame:
    """K and the most candidates that any query's text equals, at most the corpus."""
    same = corpus.groupBy(text).agg(F.count("*").alias("n"))
    most = queries.join(same, text, "left").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return most.crossJoin(corpus.agg(F.count("*").alias("size"))).select(F.least(F.lit(k) + F.col("most"), F.col("size")).cast("long").alias("pool"))


def candidate_flags(rows: DataFrame, duplicates: list[tuple[str, str]]) -> DataFrame:
    """Seven flags of (query, candidate) rows; ``duplicates``: pairs of paths that are known to hold the same bytes.

    Columns: query_image_path, submitted_caption, caption_id, image_id; evidence_image_path, evidence_id, evidence_caption.
    """
    q, e = F.col("query_image_path"), F.col("evidence_image_path")
    same_image, same_caption = F.col("evidence_id").eqNullSafe(F.col("image_id")), F.col("evidence_id").eqNullSafe(F.col("caption_id"))
    other, group = F.lit(False), F.lit(None).cast("string")
    for i, (a, b) in enumerate(duplicates, 1):
        other = other | ((q == a) & (e == b)) | ((q == b) & (e == a))
        group = F.when(e.isin(a, b), f"known_pair_{i}").otherwise(group)
    return rows.withColumns({
        "is_exact_path": e.eqNullSafe(q), "is_same_image_id": same_image, "is_caption_provenance": same_caption, "is_query_provenance": same_image | same_caption,
        "is_exact_caption": F.col("evidence_caption").eqNullSafe(F.col("submitted_caption")), "is_known_duplicate": other, "known_duplicate_group": group,
    })


FLAGS = ["is_exact_path", "is_same_image_id", "is_caption_provenance", "is_query_provenance", "is_exact_caption", "is_known_duplicate", "known_duplicate_group"]


def exclusion_mask(channel: Column) -> Column:
    """What each channel's filtered ranking leaves out."""
    image = F.col("is_exact_path") | F.col("is_same_image_id") | F.col("is_known_duplicate")
    return F.when(channel == "image_to_image", image).when(channel == "text_to_text", F.col("is_exact_caption")).otherwise(False)


def flag_contract(rows: DataFrame, duplicates: list[tuple[str, str]], queries: DataFrame, evidence: DataFrame, filtered: bool = False) -> DataFrame:
    """Flags that differ when computed again, query and evidence columns that differ from their tables, rows of unknown ids, excluded rows in a filtered ranking."""
    flags = [(~F.col(f"__{f}").eqNullSafe(F.col(f))).alias(f"flag:{f}") for f in FLAGS]
    marked = candidate_flags(rows.select("*", *[F.col(f).alias(f"__{f}") for f in FLAGS]), duplicates)
    side = lambda df, s: df.select(*[F.col(c).alias(f"__{s}_{c}") for c in df.columns], F.lit(True).alias(f"__in_{s}"))
    marked = marked.join(side(queries, "q"), F.col("query_id") == F.col("__q_query_id"), "left").join(side(evidence, "e"), F.col("evidence_id") == F.col("__e_evidence_id"), "left")
    wrong = lambda df, s: reduce(or_, [~F.col(c).eqNullSafe(F.col(f"__{s}_{c}")) for c in df.columns])
    rules = [*flags, (F.col("__in_q").isNull() | wrong(queries, "q")).alias("query_columns"), (F.col("__in_e").isNull() | wrong(evidence, "e")).alias("evidence_columns")]
    rules += [exclusion_mask(F.col("channel")).alias("excluded_kept")] if filtered else []
    counted = marked.select(*rules)
    return counted.agg(*[count_if(F.col(f"`{c}`")).alias(c) for c in counted.columns])


def refill(ranked: DataFrame, excluded: Column, k: int, query: str | list[str] = "qid") -> DataFrame:
    """Ranks after exclusion; places that are freed are taken by what comes next in the pool."""
    kept = ranked.where(~F.coalesce(excluded, F.lit(False)))
    return kept.withColumn("filtered_rank", F.row_number().over(Window.partitionBy(query).orderBy("raw_rank"))).where(F.col("filtered_rank") <= k)


def target_ranks(ranked: DataFrame, queries: DataFrame, target: str, rank: str = "raw_rank", query: str = "qid") -> DataFrame:
    """The rank at which each query meets its target; null if it doesn't."""
    hit = ranked.join(queries.select(query, target), query).where(F.col("cid") == F.col(target)).groupBy(query).agg(F.min(rank).alias("rank"))
    return queries.join(hit, query, "left")


def recall(ranks: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """Recall at each k, mean reciprocal rank (absent: 0), and absent targets."""
    r = F.col("rank")
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n_queries"), *[F.avg(F.coalesce(r <= k, F.lit(False)).cast("int")).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), count_if(r.isNull()).alias("n_absent"))


def stratified(ranks: DataFrame, ks: list[int], flag: str, category: str) -> DataFrame:
    """All queries, each class, and the flagged ones by category, in one pass of grouping sets."""
    strata = F.array(F.struct(F.lit("all").alias("stratum"), F.lit(True).alias("on")), F.struct(F.lit("pristine").alias("stratum"), (~F.col(flag)).alias("on")), F.struct(F.lit("falsified").alias("stratum"), F.col(flag).alias("on")), F.struct(F.concat(F.lit("falsified/"), F.col(category).cast("string")).alias("stratum"), F.col(flag).alias("on")))
    return recall(ranks.withColumn("x", F.explode(strata)).where("x.on").select("rank", "x.stratum"), ks, ["stratum"])


def score_summary(ranked: DataFrame, rank: str = "raw_rank") -> DataFrame:
    """The best similarity of queries, and means over all rows of the first five and ten ranks."""
    s, at = F.col("similarity"), lambda k: F.when(F.col(rank) <= k, F.col("similarity"))
    top = F.when(F.col(rank) == 1, s)
    return ranked.agg(F.avg(top).alias("top1_mean"), F.median(top).alias("top1_median"), F.min(top).alias("top1_min"), F.max(top).alias("top1_max"), F.avg(at(5)).alias("top5_mean"), F.avg(at(SUMMARY)).alias("top10_mean"))


def filter_diagnostics(ranked: DataFrame, excluded: Column, k: int, query: str = "qid") -> DataFrame:
    """How many rows exclusion took, how many queries ``refill`` refilled, rows left by query; ``ranked`` is read once."""
    marked = ranked.select(query, "raw_rank", F.coalesce(excluded, F.lit(False)).alias("gone"))
    marked = marked.withColumn("place", F.row_number().over(Window.partitionBy(query, "gone").orderBy("raw_rank")))
    gone, left, deep = F.col("gone"), ~F.col("gone") & (F.col("place") <= k), F.col("raw_rank") > k
    per = marked.groupBy(query).agg(count_if(gone).alias("lost"), count_if(gone & ~deep).alias("lost_top"), count_if(left).alias("n"), count_if(left & deep).alias("refilled"))
    kept = F.when(F.col("n") > 0, F.col("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("lost").alias("n_excluded"), total("lost_top").alias("n_excluded_top"), F.count(kept).alias("n_queries"), F.min(kept).alias("fewest"), F.max(kept).alias("most"), F.sum(F.when(F.col("n") > 0, F.col("refilled"))).alias("n_refilled"), count_if(F.col("refilled") > 0).alias("queries_refilled"))


def rank_contract(ranked: DataFrame, k: int, query: str = "qid") -> DataFrame:
    """Violations of rank order, continuity, uniqueness and score bounds; ``ranked`` is read once."""
    w = Window.partitionBy(query).orderBy("raw_rank")
    r = ranked.withColumns({"before": F.lag("raw_rank").over(w), "higher": F.lag("similarity").over(w)})
    rows = {
        "rank_gap": F.coalesce(F.col("raw_rank") - F.col("before") != 1, F.col("raw_rank") != 1), "score_rises": F.col("similarity") > F.col("higher") + 1e-6,
        "score_range": F.abs("similarity") > 1.00001, "rank_range": ~F.col("raw_rank").between(1, k),
    }
    different = lambda c: F.size(F.collect_set(c))  # noqa: E731  # a query has few rows
    per = r.groupBy(query).agg(F.count("*").alias("n"), different("raw_rank").alias("ranks"), different("cid").alias("ids"), *[count_if(x).alias(c) for c, x in rows.items()])
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in rows], count_if(F.col("n") != k).alias("short_query"), count_if(F.col("ranks") != F.col("n")).alias("rank_repeats"), count_if(F.col("ids") != F.col("n")).alias("id_repeats"))


def duplicate_pairs(ranked: DataFrame, group: Column, query: str = "qid") -> DataFrame:
    """Rows of known duplicates, queries that meet either of a group, and those that meet several."""
    per = ranked.where(group.isNotNull()).groupBy(query).agg(F.count("*").alias("n"), F.size(F.collect_set(group)).alias("groups"))  # a query has few rows
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(query).alias("queries_either"), F.count(F.when(F.col("groups") < F.col("n"), F.col(query))).alias("queries_both"))


def paired_cosine(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The inner product of the vectors that two tables have for one key."""
    return a.select(key, F.col("vec").alias("va")).join(b.select(key, F.col("vec").alias("vb")), key).select(key, P.dot(F.col("va"), F.col("vb")).alias("similarity"))


def reuse_vectors(queries: DataFrame, evidence: DataFrame, path: str) -> DataFrame:
    """Queries take the vector that the evidence has for their path."""
    return queries.join(evidence.select(path, "vec"), path)


def encode(rows: DataFrame, encoder, columns: str, key: str) -> DataFrame:
    """Rows to unit vectors by an injected batch encoder; a zero or infinite vector is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = np.asarray(encoder(b[columns].tolist()), np.float64).reshape(len(b), -1)
            n = np.linalg.norm(v, axis=1)
            if not (np.isfinite(n) & (n > 0)).all():
                raise ValueError("encoder gave a zero or infinite vector")
            yield pd.DataFrame({key: b[key], "vec": list((v / n[:, None]).astype(np.float32))})

    return rows.select(key, columns).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vec array<float>")
