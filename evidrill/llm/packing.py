"""Best-fit packing with dominance reduction.

Pieces matter to the packing only by their length, so the instance is a histogram of at
most ``capacity`` lengths, whatever the number of pieces.  First the reduction of Martello
and Toth fixes, for lengths from the longest, small sets that dominate every other set with
that length (a piece nothing fits beside; two that fill a sequence exactly; the longest
fitting partner where no two fit; a best pair where no three fit).  What is left is packed
best-fit decreasing.  Both work on whole multiplicities, so the plan has a few thousand
lines at most and is a bounded broadcast.  Pieces take their places in the plan by their
rank within their length, which is a sum over per-partition counts: no key, however
frequent, is gathered in one task.

Null and empty texts are one piece of one token (the end token).  Repeated rows are packed
as often as they come, and ids may be null.  Pieces of full length need no plan: each is a
sequence.  An empty table gives an empty result; columns but doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import BYTE_VOCAB, Recent, TreeEncoder, texts_to_bytes, vocabulary
from .common import arrow_map, column, materialize, table

CAPACITY = 1024
END = 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, r long"


@dataclass
class Group:
    """``count`` sequences filled alike; items: (length, first rank, offset)."""

    count: int
    free: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, m: int) -> Group:
        """Takes ``m`` sequences off as a group of their own."""
        off = Group(m, self.free, list(self.items))
        self.items = [(s, r + m, o) for s, r, o in self.items]
        self.count -= m
        return off


def reduce_dominated(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets; takes them from ``left`` (count by length).  -> (lengths, how often)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*sizes: int) -> None:
        need = {s: sizes.count(s) for s in sizes}
        m = min(int(left[s]) // k for s, k in need.items())
        for s, k in need.items():
            left[s] -= m * k
        fixed.append((sizes, m))

    def longest(limit: int, *used: int) -> int:
        """The longest length that is left and at most ``limit``; 0 if none."""
        have = np.flatnonzero(left[: max(limit, 0) + 1])
        for s in have[::-1]:
            if left[s] > used.count(int(s)):
                return int(s)
        return 0

    def least(n: int, but: int) -> int:
        """Total of the ``n`` shortest pieces besides one of length ``but``; over capacity if there are fewer."""
        total = 0
        for s in np.flatnonzero(left):
            k = min(n, int(left[s]) - (int(s) == but))
            total, n = total + k * int(s), n - k
            if not n:
                return total
        return capacity + 1

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while left[s]:
                room = capacity - s
                if least(1, s) > room:
                    take(s)
                elif room and left[room] > (room == s):
                    take(s, room)
                elif least(2, s) > room:
                    take(s, longest(room, s))
                elif least(3, s) > room and (a := longest(room, s)) and (b := longest(room - a, s, a)) and longest(room // 2, s) <= b:
                    take(s, a, b)
                else:
                    break
                changed = True
    return fixed


def best_fit(left: np.ndarray, capacity: int, ranks: np.ndarray) -> list[Group]:
    """Best-fit decreasing on what is left; ``ranks`` holds the next rank of each length."""
    by_free: dict[int, list[Group]] = {}
    frees: list[int] = []

    def add(g: Group) -> None:
        if g.free not in by_free:
            by_free[g.free] = []
            frees.insert(bisect_right(frees, g.free), g.free)
        by_free[g.free].append(g)

    for s in range(capacity, 0, -1):
        n = int(left[s])
        while n:
            at = bisect_right(frees, s - 1)
            if at < len(frees):
                free = frees[at]
                g = by_free[free].pop()
                if not by_free[free]:
                    del by_free[free], frees[at]
            else:
                g = Group(-(-n // (capacity // s)), capacity)
            each = g.free // s
            m, k = (min(g.count, n // each), each) if n >= each else (1, n)
            if m < g.count:
                off = g.split(m)
                if g.free < capacity:
                    add(g)
                g = off
            for _ in range(k):
                g.items.append((s, int(ranks[s]), capacity - g.free))
                ranks[s] += m
                g.free -= s
            n -= m * k
            add(g)
        left[s] = 0
    return [g for gs in by_free.values() for g in gs]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, how many, first sequence, offset) of runs of pieces of one length."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    ranks = np.zeros(capacity + 1, np.int64)
    groups = []
    for sizes, m in reduce_dominated(left, capacity):
        g = Group(m, capacity)
        for s in sizes:
            g.items.append((s, int(ranks[s]), capacity - g.free))
            ranks[s] += m
            g.free -= s
        groups.append(g)
    groups += best_fit(left, capacity, ranks)
    lines, base = [], 0
    for g in groups:
        lines += [(s, r, g.count, base, o) for s, r, o in g.items]
        base += g.count
    return sorted(lines)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each row of ``docs``; ``r`` is its rank among its partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, known, seen = TreeEncoder(path), Recent(), np.zeros(capacity + 1, np.int64)
        tail = int(end).to_bytes(4, "little")
        for b in batches:
            ids_all, texts_all = column(b, "doc_id"), column(b, "text")
            for k in range(0, len(ids_all), 512):
                rows = []
                for doc, ids in zip(ids_all[k : k + 512], texts_to_bytes(enc, texts_all[k : k + 512], known), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    for i, (a, e) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity), strict=True)):
                        rows.append((doc, i, a, e - a, zlib.crc32(memoryview(ids)[4 * a : 4 * e]), part, int(seen[e - a])))
                        seen[e - a] += 1
                cols = list(zip(*rows, strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "r"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (as from ``token_pieces``, stored) with ``sequence_id`` and ``offset``."""
    per_part = pieces.where(F.col("length") < capacity).groupBy("length", "part").agg((F.max("r") + 1).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    lines = plan(counts, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    short = pieces.where(F.col("length") < capacity).join(base, ["length", "part"]).withColumn("r", F.col("base") + F.col("r"))
    plan_cols = [np.array(c, np.int64) for c in zip(*lines, strict=True)] if lines else [np.zeros(0, np.int64)] * 5
    at = pieces.sparkSession.sparkContext.broadcast(plan_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, _, sequence, offset = at.value
        key = (length << 44) + first
        for b in batches:
            s = b.column(b.schema.get_field_index("length")).to_numpy()
            r = b.column(b.schema.get_field_index("r")).to_numpy()
            k = np.searchsorted(key, (s << 44) + r, side="right") - 1
            kept = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[k] + r - first[k]), pa.array(offset[k])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = arrow_map(short.select("doc_id", "piece", "start", "length", "ids_crc32", "r"), run, schema)
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.col("part").cast("long") * F.lit(1 << 36) + F.col("r")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenizes, cuts and packs all of ``docs``."""
    return pack(materialize(token_pieces(docs, path, capacity, end), "pieces"), capacity)


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCAB))
