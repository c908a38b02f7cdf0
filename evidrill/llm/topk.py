"""Exact top-k inner products with norm order and a rotation.

Vectors become integers.  Candidates are dealt to ranges of descending length, a range to
shards, queries to blocks; a pair of a block and a shard is one task's work, so neither side is
ever whole in one place.  The longest range is searched first; the k-th scores found there go
with the queries into the other ranges, and a query isn't sent to ranges where even |q||v|
can't reach its k-th score.  Within a shard candidates are taken by descending length again.
Lengths and all rotated coordinates come from the eigenvectors of the corpus's Gram matrix
(its right singular vectors), so the first ``HEAD`` coordinates hold most of an inner product;
the rest is bounded by Cauchy and Schwarz.  A block of candidates is passed over for queries
that even |q||v| can't lift over their k-th score, and of the others only pairs whose bound
reaches it are scored, exactly.

Vectors that are null or hold null, NaN or infinity take no part, nor do null ids; shorter
vectors are padded with zeros.  Rows with the query's own id are no candidates of it; rows that
repeat an id are candidates of their own; queries that repeat a row are asked once; equal
scores rank by id.  Empty tables give an empty result.  Vectors so long that an inner product
could pass 2^53, or a component a long, raise an error, as scores wouldn't be exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, table

SCALE = 1024
HEAD = 16
#: Candidates scored at once; components in a block of queries, and in a shard of candidates, at most; vectors in a shard, if there are enough.
STEP, QUERY_CELLS, SHARD_CELLS, SHARD = 1024, 1 << 20, 1 << 22, 8192
#: Ranges of length at most.
RANGES = 64


def integers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>): the vectors that take part."""
    ok = F.expr(f"{key} IS NOT NULL AND {vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return vectors.where(ok).select(F.col(key).cast("long").alias("id"), F.expr(f"transform({vector}, x -> cast(floor({scale} * cast(x AS double)) AS bigint))").alias("v"))


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, at = col.flatten().to_numpy(zero_copy_only=False), np.asarray(col.offsets)
    at = at - at[0]
    if len(at) > 1 and (np.diff(at) == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(at) - 1, dim))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        out[i, : b - a] = flat[a:b]
    return out


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the vectors' Gram matrix, largest first; partial matrices are summed before they are sent."""

    def run(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim)
            total += m.T @ m
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "x"])

    cells = arrow_map(vectors.select("v"), run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in cells:
        gram[r["i"], r["j"]] = r["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1]


def search(q: np.ndarray, qid: np.ndarray, c: np.ndarray, cid: np.ndarray, r: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[int, int, int]]:
    """(query, candidate, score): of each query the k best candidates of one shard that reach its ``floor``."""
    norm = np.sqrt((c * c).sum(axis=1))
    order = np.lexsort((cid, -norm))
    c, cid, norm = c[order], cid[order], norm[order]
    qn = np.sqrt((q * q).sum(axis=1))
    qr, cr = q @ r, c @ r
    head = min(HEAD, q.shape[1])
    q_rest, c_rest = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (qr, cr))
    best: list[list[tuple[int, int]]] = [[] for _ in qid]  # (-score, id), sorted
    floor = floor.copy()
    slack = 1e-6 * (1 + qn) * (1 + norm.max(initial=0))  # rounding of rotated coordinates
    for a in range(0, len(cid), STEP):
        live = np.flatnonzero(qn * norm[a] + slack >= floor)
        if not len(live):
            break
        b = slice(a, a + STEP)
        bound = qr[live, :head] @ cr[b, :head].T + q_rest[live, None] * c_rest[None, b] + slack[live, None]
        reach = bound >= floor[live, None]
        for row in np.flatnonzero(reach.any(axis=1)):
            i = live[row]
            at = np.flatnonzero(reach[row])
            ids = cid[b][at]
            score = c[b][at] @ q[i]  # integers below 2^53: exact
            keep = (ids != qid[i]) & (score >= floor[i])
            score, ids = score[keep], ids[keep]
            if len(score):
                top = np.lexsort((ids, -score))[:k]
                best[i] = sorted(best[i] + [(-int(s), int(x)) for s, x in zip(score[top], ids[top], strict=True)])[:k]
                if len(best[i]) == k:
                    floor[i] = max(floor[i], -best[i][-1][0])
    return [(int(qid[i]), x, -s) for i, found in enumerate(best) for s, x in found]


def _one_of(cases: dict[int, int | float], key: str) -> F.Column:
    """The value of the column ``key`` in a small table."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in cases.items() for x in kv]), F.col(key))


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from (id, v) of queries and candidates."""
    spark = candidates.sparkSession
    norm = F.expr("sqrt(aggregate(v, 0D, (a, x) -> a + cast(x AS double) * x))").alias("norm")
    candidates, queries = materialize(candidates.select("id", "v", norm), "candidates"), materialize(queries.dropDuplicates().select("id", "v", norm), "queries")
    n, dim, most = candidates.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    nq, qdim, qmost = queries.agg(F.count("*"), F.max(F.size("v")), F.max("norm")).first()
    if (most or 0) * (qmost or 0) >= 2**53:
        raise ValueError("inner products of these vectors pass 2^53")
    dim = max(dim or 1, qdim or 1)
    turn = rotation(candidates, dim)
    rows = max(1, min(SHARD_CELLS // dim, max(SHARD, n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    ranges = max(1, min(RANGES, -(-n // rows)))
    bounds = sorted(set(candidates.approxQuantile("norm", [1 - i / ranges for i in range(1, ranges)], 0.1 / ranges)), reverse=True) if ranges > 1 else []
    by_length = F.expr(f"{' + '.join(f'int(norm < {x!r}D)' for x in bounds) or '0'}").alias("range")
    dealt = candidates.select("id", "v", "norm", by_length)
    of = {r["range"]: (r["n"], r["most"]) for r in dealt.groupBy("range").agg(F.count("*").alias("n"), F.max("norm").alias("most")).collect()}  # RANGES rows at most
    if not of or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = {r: -(-m // rows) for r, (m, _) in of.items()}
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("id", "v"), _one_of(shards, "range")).cast("int"))
    asked = max(1, -(-nq // max(1, QUERY_CELLS // dim)))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(asked)).cast("int"))

    def run(c: pa.Table, q: pa.Table) -> pa.Table:
        found = search(_matrix(q["v"], dim), q["id"].to_numpy(), _matrix(c["v"], dim), c["id"].to_numpy(), turn, k, q["floor"].to_numpy()) if c.num_rows and q.num_rows else []
        cols = list(zip(*found, strict=True)) or [[]] * 3
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    def searched(chosen: list[int], floors: DataFrame) -> DataFrame:
        """The best of each query in some ranges; ``floors``: (id, v, norm, block, floor)."""
        reach = [F.struct(F.lit(r).alias("range"), F.lit(float(of[r][1])).alias("most"), F.lit(shards[r]).alias("shards")) for r in chosen]
        asks = floors.withColumn("x", F.explode(F.array(*reach))).where(F.col("norm") * F.col("x.most") + F.lit(1e-6) * (1 + F.col("norm")) * (1 + F.col("x.most")) >= F.col("floor"))
        asks = asks.select("id", "v", "floor", "block", F.col("x.range").alias("range"), F.explode(F.sequence(F.lit(0), F.col("x.shards") - 1)).alias("shard"))
        left = dealt.where(F.col("range").isin(chosen)).select("id", "v", "range", "shard", F.explode(F.sequence(F.lit(0), F.lit(asked - 1))).alias("block"))
        key = ["block", "range", "shard"]
        found = left.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(run, "query_id long, vec_id long, score long")
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    longest = min(of)
    best = materialize(searched([longest], blocked.withColumn("floor", F.lit(float("-inf")))), "longest")
    rest = [r for r in sorted(of) if r != longest]
    if not rest:
        discard(candidates, queries)
        return best
    kth = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    floors = blocked.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = best.drop("rank").unionByName(searched(rest, floors).drop("rank"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_inner_products(vectors.where("id % 100 = 0"), vectors, 10)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
