"""Repeated passages by a run-length index.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier in the
corpus.  Equal strings choose the same anchor: the rightmost smallest hash among their
``K``-byte substrings.  So a document is a row of runs of neighbouring strings with one
anchor each, about one run for 35 bytes, and only runs with the same anchor can hold equal
strings.  Runs meet by anchor hash, packed as arrays; those that occur once in the corpus
end there.  Of runs that are equal as a whole, all but the first are removed (a task does
so for its own runs before anything is shuffled, so frequent passages stay even).

Where one anchor has different runs around it, their bytes are fetched and go into a run-length
index: the run-compressed Burrows-Wheeler transform with the text positions sampled at the ends
of its runs.  From these samples alone the matching statistics are streamed over the text: for
each position, the lexicographic predecessor and how many bytes it has in common with it.
Matches of at least ``length`` bytes chain equal strings together, and a string is removed if
its chain has an earlier start.  An anchor with more bytes around it than ``CROWDED`` isn't one
task's work: its strings meet one by one, by a 128-bit hash of their bytes.

Texts are UTF-8 bytes; null is empty.  Rows with the same doc_id and text are one document
and get the same spans; a null doc_id comes after all others, those by a hash of their text.
Empty texts keep nothing, an empty table gives an empty result, other columns are ignored
(``remove_repeats``) or kept (``without_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, materialize, table, trim
from .hashing import blocks, mix, prefix, spans, windows

_U = np.uint64
LENGTH = 100
K = 32
_POS = 24
_LOW = _U((1 << _POS) - 1)
#: Bytes of one text hashed at once; a longer text is cut, with overlap.
SLICE = 1 << 20
#: Bytes of text whose runs a task collapses and sends together.
FLUSH = 24 << 20
#: Bytes of runs in one index, about, and around one anchor at most.
INDEX, CROWDED = 1 << 18, 1 << 20
#: Bytes of text whose runs meet in one bucket, about.
BUCKET = 24 << 20
_ENTRY = np.dtype([("kh", "<u8"), ("ch", "<u8"), ("doc", "<i8"), ("th", "<i8"), ("s0", "<i4"), ("off", "u1"), ("n", "u1")])
_LAST = (1 << 63) - 1


# -- anchors ----------------------------------------------------------------------------


def anchor_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K):
    """Runs of strings with one anchor: (first start, last start, anchor, anchor hash, hash of all bytes)."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    valid = np.zeros(n + 1, np.int8)
    long = ends - starts >= length
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - length + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[:-1]))
    if not len(s):
        return none, none, none, none.astype(_U), none.astype(_U)
    sums = prefix(data)
    hk = mix(windows(sums, k))
    w = length - k + 1
    key = np.full(-(-len(hk) // w) * w, np.iinfo(np.uint64).max, _U)
    key[: len(hk)] = (hk & ~_LOW) | (_LOW - np.arange(len(hk), dtype=_U))
    grid = key.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (_LOW - (np.minimum(tail[s], head[s + w - 1]) & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    s0, s1, p = s[first], s[last], p[first]
    return s0, s1, p, hk[p], spans(sums, s0, s1 + length)


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 1), SLICE):
            yield i, a, t[a : a + SLICE + length - 1]


def _earlier_first(e: np.ndarray) -> np.ndarray:
    """Sorted entries, each once: those of repeated rows are the same entry, not a repeat of it."""
    e = e[np.lexsort((e["s0"], e["th"], e["doc"], e["off"], e["n"], e["ch"], e["kh"]))]
    return e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e


def _repeats(e: np.ndarray) -> np.ndarray:
    """Of sorted entries, which are equal to the one before."""
    out = np.zeros(len(e), bool)
    if len(e):
        out[1:] = (e["kh"][1:] == e["kh"][:-1]) & (e["ch"][1:] == e["ch"][:-1]) & (e["off"][1:] == e["off"][:-1]) & (e["n"][1:] == e["n"][:-1])
    return out


def _entries(docs: DataFrame, buckets: int, length: int) -> DataFrame:
    """(bucket, kind, blob): packed runs by anchor hash (kind 0), and runs known to be repeats (kind 1)."""

    def out(parts: list[np.ndarray]) -> pa.RecordBatch:
        e = _earlier_first(np.concatenate(parts))
        again = _repeats(e)
        rows = []
        for kind, x in ((0, e[~again]), (1, e[again])):
            b = (x["kh"] % _U(buckets) if kind == 0 else mix(x["doc"].view(_U) ^ x["th"].view(_U)) % _U(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            x, cuts = x[order], np.searchsorted(b[order], np.arange(buckets + 1))
            rows += [(i, kind, x[cuts[i] : cuts[i + 1]].tobytes()) for i in range(buckets) if cuts[i + 1] > cuts[i]]
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = batch.column(2).to_pylist()
            cut = list(_slices(texts, length))
            for a, b in blocks([t for _, _, t in cut]):
                row, base = np.array([(i, x) for i, x, _ in cut[a:b]], np.int64).T
                data = np.frombuffer(b"".join([t for _, _, t in cut[a:b]]), np.uint8)
                ends = np.cumsum([len(t) for _, _, t in cut[a:b]])
                starts = np.concatenate([[0], ends[:-1]])
                s0, s1, p, kh, ch = anchor_runs(data, starts, ends, length)
                at = np.searchsorted(starts, s0, side="right") - 1
                e = np.zeros(len(s0), _ENTRY)
                e["kh"], e["ch"], e["doc"], e["th"] = kh, ch, doc[row[at]], th[row[at]]
                e["s0"], e["off"], e["n"] = s0 - starts[at] + base[at], p - s0, s1 - s0
                parts.append(e)
                total += len(data)
                if total >= FLUSH:
                    yield out(parts)
                    parts, total = [], 0
        if parts:
            yield out(parts)

    return arrow_map(docs, run, "bucket int, kind int, blob binary")


def _meet(entries: DataFrame, length: int) -> DataFrame:
    """(doc, th, s0, s1, p, kh, removed, crowded): runs that repeat, and those whose bytes must be compared; all runs around an anchor meet here."""
    most = CROWDED

    def run(t: pa.Table) -> pa.Table:
        trim()
        kind, blob = t.column("kind").to_pylist(), t.column("blob").to_pylist()
        known = np.frombuffer(b"".join([x for x, k in zip(blob, kind, strict=True) if k]), _ENTRY)
        e = _earlier_first(np.frombuffer(b"".join([x for x, k in zip(blob, kind, strict=True) if not k]), _ENTRY))
        again = _repeats(e)
        one = e[~again]
        differ = np.zeros(len(one), bool)
        if len(one):
            same = one["kh"][1:] == one["kh"][:-1]
            differ[1:] |= same
            differ[:-1] |= same
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            size = np.add.reduceat(one["n"].astype(np.int64) + length, first)
            around = np.repeat(size, np.diff(np.concatenate([first, [len(one)]])))
        else:
            around = np.zeros(0, np.int64)
        rows = np.concatenate([known, e[again], one[differ]])
        removed = np.arange(len(rows)) < len(rows) - int(differ.sum())
        crowded = np.concatenate([np.zeros(len(rows) - int(differ.sum()), bool), around[differ] > most])
        s0 = rows["s0"].astype(np.int64)
        return pa.table({"doc": rows["doc"], "th": rows["th"], "s0": s0, "s1": s0 + rows["n"], "p": s0 + rows["off"], "kh": rows["kh"].view(np.int64), "removed": removed, "crowded": crowded})

    return entries.groupBy("bucket").applyInArrow(run, "doc long, th long, s0 long, s1 long, p long, kh long, removed boolean, crowded boolean")


# -- the index --------------------------------------------------------------------------


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of a list of byte strings, each ended by a mark of its own.

    starts, heads: of each run its first row and its symbol.  ends: the text position of the
    suffix at the last row of each run.  The suffix array exists only while the index is built.
    """

    def __init__(self, texts: list[bytes]):
        m = len(texts)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        self.n = n = int(self.offsets[-1])
        symbol = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + m
        symbol[self.offsets[1:] - 1] = np.arange(m)
        rank, h = symbol, 1
        power = [(1, rank.astype(np.int32))]
        if m + 256 < 1 << 15:  # four symbols fit in a word
            wide = np.concatenate([symbol, np.zeros(4, np.int64)])
            rank, h = self._ranks((wide[:n] << 45) | (wide[1 : n + 1] << 30) | (wide[2 : n + 2] << 15) | wide[3 : n + 3]), 4
            power.append((4, rank.astype(np.int32)))
        longest = int(self.lengths.max(initial=0)) + 1
        while h < longest:
            after = np.zeros(n, np.int64)
            after[: max(n - h, 0)] = rank[h:] + 1
            rank, h = self._ranks(rank * (n + 1) + after), 2 * h
            power.append((h, rank.astype(np.int32)))
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = symbol[sa - 1]  # before the first text comes the last mark
        self.starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.heads = bwt[self.starts]
        self.ends = sa[np.concatenate([self.starts[1:], [n]]) - 1]
        self._sample(sa[self.starts], power)

    def _sample(self, first: np.ndarray, power: list[tuple[int, np.ndarray]]) -> None:
        """Where predecessors jump: ``at``, the position before a run's first suffix, its predecessor and their common length.

        LF takes the first row of a run next to the last row of the run with the same or the next
        smaller symbol before it.  Between two jumps, predecessors step with their positions.
        """
        order = np.argsort(self.heads, kind="stable")
        at, before = (first[order] - 1) % self.n, np.concatenate([[-1], (self.ends[order][:-1] - 1) % self.n])
        a, b, common = at.copy(), before.copy(), np.zeros(len(at), np.int64)
        live = b >= 0
        for h, rank in reversed(power):  # as many symbols as agree
            ok = np.flatnonzero(live & (np.maximum(a, b) < self.n))
            same = ok[rank[a[ok]] == rank[b[ok]]]
            a[same], b[same], common[same] = a[same] + h, b[same] + h, common[same] + h
            if h == 4:  # up to three more
                for _ in range(2):
                    ok = np.flatnonzero(live & (np.maximum(a, b) < self.n))
                    same = ok[power[0][1][a[ok]] == power[0][1][b[ok]]]
                    a[same], b[same], common[same] = a[same] + 1, b[same] + 1, common[same] + 1
        by = np.argsort(at)
        self.at, self.before, self.common = at[by], before[by], common[by]

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
        return rank

    def statistics(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the positions [a, b): predecessors (-1: none), and common lengths."""
        i = np.arange(a, b)
        k = np.searchsorted(self.at, i)
        step = self.at[k] - i
        return np.where(self.before[k] < 0, -1, self.before[k] - step), np.where(self.before[k] < 0, 0, self.common[k] + step)

    def repeated(self, depth: int) -> list[np.ndarray]:
        """For each text the starts of strings of ``depth`` bytes that also start earlier."""
        link = np.arange(self.n)
        for a in range(0, self.n, 1 << 16):
            before, common = self.statistics(a, min(a + (1 << 16), self.n))
            long = common >= depth
            link[a : a + len(long)][long] = before[long]
        while True:  # to the head of each chain
            further = link[link]
            if (further == link).all():
                break
            link = further
        least = np.arange(self.n)
        np.minimum.at(least, link, np.arange(self.n))
        hit = np.flatnonzero(least[link] < np.arange(self.n))
        cuts = np.searchsorted(hit, self.offsets)
        return [hit[x:y] - o for x, y, o in zip(cuts[:-1], cuts[1:], self.offsets[:-1], strict=True)]


def _compare(runs: DataFrame, length: int) -> DataFrame:
    """(doc, th, s0, s1): starts of strings that an earlier run with the same anchor has too."""

    def index(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        texts = [r[4] for r in rows]
        for (_, doc, th, s0, _), hit in zip(rows, RunLengthIndex(texts).repeated(length), strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, b in zip(hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])], strict=True):
                    out.append((doc, th, s0 + int(a), s0 + int(b)))
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "th", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(column(b, c) for c in ("kh", "doc", "th", "s0", "bytes")), strict=True):
                if rows and r[:4] == rows[-1][:4]:  # of a repeated row
                    continue
                if size >= INDEX and r[0] != rows[-1][0]:
                    yield index(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4]) + 1
        if rows:
            yield index(rows)

    ordered = runs.repartition("kh").sortWithinPartitions("kh", "doc", "th", "s0")
    return arrow_map(ordered, run, "doc long, th long, s0 long, s1 long")


def _keyed(docs: DataFrame) -> DataFrame:
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(data).alias("th"), data.alias("bytes"))


def _one_by_one(runs: DataFrame, length: int) -> DataFrame:
    """As ``_compare``, for anchors with very many runs: strings meet by a hash of their bytes, so no key holds more than the copies of one string."""
    each = runs.select("doc", "th", "s0", "bytes", F.explode(F.sequence(F.lit(0), F.length("bytes") - length)).alias("i"))
    each = each.select(F.md5(F.expr(f"substring(bytes, i + 1, {length})")).alias("key"), F.struct("doc", "th", (F.col("s0") + F.col("i")).alias("s0")).alias("place"))
    first = each.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    again = each.join(first, "key").where("place > first")
    return again.select("place.doc", "place.th", "place.s0", F.col("place.s0").alias("s1"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, th, spans): of each document with repeats, [start, end) of byte runs to remove, maybe overlapping."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    met = materialize(_meet(_entries(keyed, buckets, length), length), "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(x["kh"], doc, th, x["s0"], t[x["s0"] : x["s1"] + length]) for doc, th, t, xs in zip(column(b, "doc"), column(b, "th"), column(b, "bytes"), column(b, "asked"), strict=True) for x in xs]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=["kh", "doc", "th", "s0", "bytes"])

    def fetched(runs: DataFrame) -> DataFrame:
        asked = runs.groupBy("doc", "th").agg(F.collect_set(F.struct("s0", "s1", "kh")).alias("asked"))
        return arrow_map(keyed.join(asked, ["doc", "th"]).select("doc", "th", "bytes", "asked"), fetch, "kh long, doc long, th long, s0 long, bytes binary")

    differ = met.where("not removed")
    found = [met.where("removed").select("doc", "th", "s0", "s1"), _compare(fetched(differ.where("not crowded")), length)]
    if not met.where("crowded").isEmpty():
        found.append(_one_by_one(fetched(differ.where("crowded")), length))
    every = found[0].unionByName(found[1]) if len(found) == 2 else found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("doc", "th").agg(F.collect_list(F.struct("s0", (F.col("s1") + length).alias("s1"))).alias("spans"))


def merged(spans_: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of [start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted((x["s0"], x["s1"]) for x in spans_):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for s in gone for x in s), len(data)]
    return b"".join([data[a:b] for a, b in zip(at[::2], at[1::2], strict=True)])


def cut_text(data: bytes, gone: list[tuple[int, int]]) -> str:
    """``data`` without the spans, less the code points that a span covers only in part."""
    whole = []
    for a, b in gone:
        while a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            whole.append((a, b))
    return cut(data, whole).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = repeated_spans(docs, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, parts, sha = [], [], [], []
            for t, s in zip(column(b, "bytes"), column(b, "spans"), strict=True):
                runs = merged(s or [])
                n.append(len(t))
                gone.append(sum(y - x for x, y in runs))
                parts.append(len(runs))
                sha.append(hashlib.sha256(cut(t, runs)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _keyed(docs).join(found, ["doc", "th"], "left").select(F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), "bytes", "spans")
    return arrow_map(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeats cut from text, as whole code points, and n_chars (if there) counted anew."""
    found = repeated_spans(docs, length)
    names = [f"__{i}" for i in range(len(docs.columns))]  # names of ours can't clash
    at = docs.columns.index("text")
    data = F.coalesce(F.col(names[at]).cast("binary"), F.lit(b"").cast("binary"))
    rows = docs.toDF(*names).withColumns({"__doc": F.coalesce(F.col(names[docs.columns.index("doc_id")]).cast("long"), F.lit(_LAST)), "__th": F.xxhash64(data)})
    rows = rows.join(found.select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), ["__doc", "__th"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if t is None or not s else cut_text(t.encode("utf-8", "surrogatepass"), merged(s)) for t, s in zip(column(b, names[at]), column(b, "__spans"), strict=True)]
            cols = list(b.columns[:-1])
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    kept = rows.select(*names, "__spans")
    cut_rows = arrow_map(kept, run, kept.drop("__spans").schema).toDF(*docs.columns)
    return cut_rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut_rows


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
