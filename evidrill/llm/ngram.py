"""Language-model scores with stupid backoff, each document against all others.

Texts are packed in blocks (a dictionary of word hashes, and the words as numbers).  Every
block sends its distinct n-grams with their counts, sorted by hash and cut into ranges: these
are the count tables, partitioned by hash.  There are as many ranges as keep a range's
n-grams near ``RANGE``, however large the input.  A range sums the counts over blocks and
answers each block in its own order, so a frequent n-gram costs one entry a block.  A block
joins the answers to its exploded n-grams and sums over each document's words:

    c(abc) / c(ab), else 0.4 c(bc) / c(b), else 0.16 c(c) / N, else 0.16 / (N + 1)

where a document's own n-grams don't count, and the first words have shorter contexts.
Words are lower-cased (A-Z) and split at ASCII blanks.

N-grams are known by ``BITS`` bits of hash.  Two of d distinct n-grams share one with
probability d / 2^BITS: one in 70,000 n-grams at 10^12 distinct ones, whose counts are then
added up.

A row without words has n_words 0, log_score 0 and a null mean_score.  Repeated rows are
documents of their own, so they support each other; ids may be null or repeat.  Columns but
doc_id and text are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, table, trim
from .hashing import _BLANK, blocks, mix, words

_U = np.uint64
ORDER, BACKOFF, BITS = 3, 0.4, 56
#: Bytes of text in a block, and hashed at once.
TEXT, PIECE = 8 << 20, 1 << 20
#: N-grams of one order that a range takes from all blocks, about.
RANGE = 1 << 21


def planes(a: np.ndarray) -> bytes:
    """The array's bytes by significance, compressed: high ones are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).data)


def unplanes(b: bytes, kind: type) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def out(ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal block
            for a, b in blocks(texts, TEXT):
                parts = [words(texts[a + x : a + y]) for x, y in blocks(texts[a:b], PIECE)]
                word = np.concatenate([w for w, _ in parts])
                lengths = np.concatenate([np.diff(at) for _, at in parts]).astype(np.int64)
                known, number, count = np.unique(word, return_inverse=True, return_counts=True)
                rank = np.empty(len(known), np.uint32)
                rank[np.argsort(-count, kind="stable")] = np.arange(len(known), dtype=np.uint32)
                vocabulary = np.empty(len(known), _U)
                vocabulary[rank] = known
                row = [block, [x for x in ids[a:b]], planes(lengths), vocabulary.tobytes(), planes(rank[number])]
                block += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "ids", "lengths", "vocabulary", "numbers"])

        ids: list = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for doc, text in zip(column(b, "doc_id"), column(b, "text"), strict=True):
                ids.append(doc)
                texts.append(bytes(text or b""))
                size += len(texts[-1])
                if size >= TEXT:
                    yield from out(ids, texts)
                    ids, texts, size = [], [], 0
        yield from out(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, run, "block long, ids array<long>, lengths binary, vocabulary binary, numbers binary")


def _grams(lengths: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By order: the words at which an n-gram of one document ends, and the n-grams' hashes."""
    n = len(word)
    place = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    h = np.zeros(n, _U)
    for order in range(1, ORDER + 1):
        before = np.zeros(n, _U)
        before[1:] = h[:-1]
        h = mix(before * _U(0xD6E8FEB86659FD93) + word + _U(order))
        whole = np.flatnonzero(place >= order - 1).astype(np.int32)
        yield whole, h[whole] >> _U(64 - BITS)


def _tables(packed: DataFrame, ranges: int) -> DataFrame:
    """(part, gram, block, hashes, counts): each block's distinct n-grams of one order in one range of hashes."""
    width = -(-(1 << BITS) // ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lengths, vocabulary, numbers in zip(*(column(b, c) for c in ("block", "lengths", "vocabulary", "numbers")), strict=True):
                word = np.frombuffer(vocabulary, _U)[unplanes(numbers, np.uint32)]
                rows = []
                for order, (_, h) in enumerate(_grams(unplanes(lengths, np.int64), word), 1):
                    gram, count = np.unique(h, return_counts=True)
                    cuts = np.searchsorted(gram, np.arange(ranges + 1, dtype=_U) * _U(width))
                    for i in np.flatnonzero(np.diff(cuts)):
                        x = gram[cuts[i] : cuts[i + 1]]
                        rows.append((int(i), order, block, planes(np.diff(x, prepend=_U(0))), planes(count[cuts[i] : cuts[i + 1]].astype(np.uint32))))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "gram", "block", "hashes", "counts"])

    return arrow_map(packed, run, "part int, gram int, block long, hashes binary, counts binary")


def _summed(tables: DataFrame) -> DataFrame:
    """(block, gram, part, totals): the counts over all blocks of what a block has sent, in its order."""

    def run(t: pa.Table) -> pa.Table:
        trim()
        hashes = [np.cumsum(unplanes(x, _U)) for x in t.column("hashes").to_pylist()]
        counts = [unplanes(x, np.uint32) for x in t.column("counts").to_pylist()]
        gram, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(gram)).astype(_U)[at]
        ends = np.cumsum([len(x) for x in hashes])
        parts = [planes(total[e - len(x) : e]) for e, x in zip(ends, hashes, strict=True)]
        return pa.table({"block": t.column("block"), "gram": t.column("gram"), "part": t.column("part"), "totals": pa.array(parts, pa.binary())})

    return tables.groupBy("part", "gram").applyInArrow(run, "block long, gram int, part int, totals binary")


def _scores(packed: DataFrame, totals: DataFrame, n_words: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        trim()
        ids = left.column("ids").to_pylist()[0]
        lengths = unplanes(left.column("lengths")[0].as_py(), np.int64)
        word = np.frombuffer(left.column("vocabulary")[0].as_py(), _U)[unplanes(left.column("numbers")[0].as_py(), np.uint32)]
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        which = sorted(zip(right.column("gram").to_pylist(), right.column("part").to_pylist(), range(right.num_rows), strict=True))
        totals = right.column("totals")
        rest = np.maximum(n_words - lengths, 1).astype(float)[doc]
        p = BACKOFF**2 / (rest + 1)
        before = None  # of the order below: how often the n-gram that ends at a word is in other documents
        for order, (whole, h) in enumerate(_grams(lengths, word), 1):
            c = np.zeros(len(word))
            if len(whole):
                by = np.argsort(h, kind="stable").astype(np.int32)  # by n-gram, then by document
                h, at = h[by], whole[by]
                del by
                new = np.concatenate([[True], h[1:] != h[:-1]])
                first = np.flatnonzero(new | np.concatenate([[True], doc[at[1:]] != doc[at[:-1]]])).astype(np.int32)
                own = np.diff(first, append=np.int32(len(h)))
                answer = np.concatenate([unplanes(totals[i].as_py(), _U) for g, _, i in which if g == order]).astype(float)
                c[at] = answer[np.cumsum(new, dtype=np.int32) - 1] - np.repeat(own, own)
                del h, at, new, first, own, answer
            if order == 1:
                p = np.where(c > 0, BACKOFF**2 * c / rest, p)
            else:
                context = np.concatenate([[0.0], before[:-1]]) if len(word) else before
                p = np.where((c > 0) & (context > 0), BACKOFF ** (ORDER - order) * c / np.maximum(context, 1), p)
            before = c
        total = np.bincount(doc, weights=np.log10(p), minlength=len(ids)) if len(word) else np.zeros(len(ids))
        mean = [float(s / n) if n else None for s, n in zip(total, lengths, strict=True)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(lengths, pa.int64()), "log_score": pa.array(total, pa.float64()), "mean_score": pa.array(mean, pa.float64())})

    return packed.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, log_score double, mean_score double")


def _n_words(docs: DataFrame) -> int:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for text in column(b, "text"):
                for a in range(0, len(text or b""), PIECE):
                    blank = _BLANK[np.frombuffer(text[max(a - 1, 0) : a + PIECE], np.uint8)]
                    n += int((blank[:-1] & ~blank[1:]).sum()) + int(a == 0 and not blank[0])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return arrow_map(docs.select(F.col("text").cast("binary").alias("text")), count, "n long").agg(F.sum("n")).first()[0] or 0


def score(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, log_score (base 10, summed), mean_score (by word)."""
    n_words = _n_words(docs)
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_words // RANGE))
    packed = _packed(docs).repartition("block")  # made once; the tables and the scores read this exchange
    return _scores(packed, _summed(_tables(packed, ranges)), n_words)


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
