"""Near-duplicate components by fast similarity sketching.

Rows with the same shingle set form a class.  A class's set is sketched by rounds of hashed
bin placement: in round i every shingle falls in a random bin with the value (i, random);
a bin keeps its smallest value, and from round ``t`` on each round feeds one bin, so that
every coordinate is filled after at most 2t rounds.  Coordinates are banded, and classes
that share a band are candidates.

No pair of candidates is ever a row.  Each band sends an edge from every member to its
smallest member; the components of these edges are clusters, and two candidates lie in one
cluster.  Each class's full set goes once to its cluster, where a task links the members
exactly (``forest``): the prefix filter finds whom a set can be linked with, pairs that
are in one component already are skipped, and every link is confirmed on full sets.

A cluster of more than ``SET_LIMIT`` shingles isn't one task's work.  It is taken band by
band instead (bands with the same members once), and a band over the limit in blocks.  Then
the blocks' largest components are joined by one member of each, and only members outside a
band's largest component meet the other blocks.  So rows grow with the members, and no task
holds more than about twice the limit.

A link is missed only if its two sets share no band: with likeness s, ``bands`` b and
``rows`` r, with probability (1 - s^r)^b, at most 2e-7 at 0.85 (25 bands of 5) and 5e-8 at 0.8
(32 bands of 4), unless other documents bring the two in one cluster.

Rows without words have no link; a null doc_id is kept and linked with nothing (null
component); rows that repeat a doc_id share that id's component.  Extra columns are ignored,
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, discard, materialize, table
from .hashing import blocks, mix, shingles, words

_U = np.uint64
#: Shingles in a cluster, or a block of a band, that one task takes.
SET_LIMIT = 2_000_000


def sketch(h: np.ndarray, t: int) -> np.ndarray:
    """``t`` coordinates of the set ``h`` of distinct 64-bit words, which isn't empty."""
    out = np.full(t, np.iinfo(np.uint64).max, _U)
    n, i = len(h), 0
    while i < t and (i == 0 or (out == np.iinfo(np.uint64).max).any()):
        m = min(t - i, max(1, 2048 // n))
        rounds = np.arange(i, i + m, dtype=_U)[:, None]
        x = mix(h[None, :] + (rounds + _U(1)) * _U(0xA0761D6478BD642F))
        bins = ((x >> _U(32)) * _U(t)) >> _U(32)
        np.minimum.at(out, bins.ravel(), ((rounds << _U(32)) | (x & _U(0xFFFFFFFF))).ravel())
        i += m
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        x = mix(h + _U((t + int(b) + 1) * 0xA0761D6478BD642F % (1 << 64)))
        out[b] = (_U(t + int(b)) << _U(32)) | (x & _U(0xFFFFFFFF)).min()
    return out


def _signature(h: np.ndarray) -> tuple[int, int]:
    a = mix(h ^ _U(0x5851F42D4C957F2D))
    return int(a.sum(dtype=_U).view(np.int64)), int(np.bitwise_xor.reduce(mix(a), initial=_U(0)).view(np.int64))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    texts = [(t or "").encode("utf-8", "surrogatepass") for t in column(batch, "text")]
    for a, b in blocks(texts):
        word, at = words(texts[a:b])
        for i in range(b - a):
            yield shingles(word[at[i] : at[i + 1]], k)


def _class_id():
    return F.xxhash64("sig1", "sig2", "n")


def _sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, c, bands): of each row its set's size, class (null without words) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for h in _sets(b, k):
                if len(h):
                    keys = np.arange(1, bands + 1, dtype=_U)
                    for c in sketch(h, bands * rows).reshape(bands, rows).T:
                        keys = mix(keys * _U(0x9E3779B97F4A7C15) + c)
                    out.append((len(h), *_signature(h), keys.view(np.int64).tolist()))
                else:
                    out.append((0, 0, 0, []))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n", "sig1", "sig2", "bands"])

    found = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, sig1 long, sig2 long, bands array<long>")
    return found.select("doc_id", "n", F.when(F.col("n") > 0, _class_id()).alias("c"), "bands")


def _with_sets(members: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``members`` (label, c, rep) with h: the set of class c, read from the document ``rep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(len(h), *_signature(h), h.tobytes()) for h in _sets(b, k)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            kept = ["label", "c", "rep"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in kept), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[*kept, "n", "sig1", "sig2", "h"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("label", "c", "rep"), "rep")
    found = arrow_map(texts.select("label", "c", "rep", "text"), run, "label long, c long, rep long, n long, sig1 long, sig2 long, h binary")
    return found.where(F.col("c") == _class_id()).select("label", "c", "rep", "n", "h")  # rows that repeat an id may have another text


def forest(sets: list[np.ndarray], num: int, den: int, known: list | None = None, right: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Components of ``sets`` under den * |intersection| >= num * |union|, and links that span them.

    ``known``: labels of components that are known beforehand.  ``right``: compares only these
    members with the others.
    """
    m = len(sets)
    comp = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(m)
    edges: list[tuple[int, int]] = []
    size = np.array([len(x) for x in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(value), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(value))
    owner = np.repeat(np.arange(m), size)
    code = rank[code]
    code = code[np.lexsort((code, owner))]  # in each set the rarest first
    central = np.add.reduceat(np.sort(count)[code], at[:-1]) / size
    prefix = size - -(-num * size // den) + 1
    first = np.arange(len(code)) - np.repeat(at[:-1], size) < np.repeat(prefix, size)
    by = np.argsort(code[first], kind="stable")
    posted, holder = code[first][by], owner[first][by]
    turn = np.argsort(-central, kind="stable")
    place = np.empty(m, np.int64)
    place[turn] = np.arange(m)
    flag = np.zeros(len(value), bool)
    for i in turn:
        if (comp == comp[i]).all():
            break
        mine = code[at[i] : at[i] + prefix[i]]
        lo, hi = np.searchsorted(posted, mine), np.searchsorted(posted, mine, side="right")
        other, shared = np.unique(holder[_ranges(lo, hi)], return_counts=True)
        able = (place[other] > place[i]) & (comp[other] != comp[i]) & (np.minimum(size[other], size[i]) * den >= np.maximum(size[other], size[i]) * num)
        if right is not None:
            able &= right[other] != right[i]
        other = other[able][np.argsort(-shared[able], kind="stable")]
        flag[code[at[i] : at[i + 1]]] = True
        step = 32
        while len(other):
            now, other, step = other[:step], other[step:], 4 * step
            both = np.add.reduceat(flag[code[_ranges(at[now], at[now + 1])]].astype(np.int64), np.concatenate([[0], np.cumsum(size[now])[:-1]]))
            for j in now[den * both >= num * (size[now] + size[i] - both)]:
                if comp[j] != comp[i]:
                    edges.append((int(i), int(j)))
                    comp[comp == comp[j]] = comp[i]
            other = other[comp[other] != comp[i]]
        flag[code[at[i] : at[i + 1]]] = False
    return comp, edges


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - lo, n)


def _by_unit(rows: DataFrame, names: list[str], work, schema: str) -> DataFrame:
    """``work`` on the members of each ``unit`` (lists by column of ``names``), each class once; it yields result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple] = []
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * len(out_names)
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=out_names)
            out.clear()
            return made

        unit = None
        for b in batches:
            for row in zip(*(column(b, x) for x in ("unit", *names)), strict=True):
                if held and row[0] != unit:
                    out.extend(work(list(zip(*held, strict=True))))
                    held = []
                    if len(out) >= 20_000:
                        yield batch()
                unit = row[0]
                if not held or held[-1] != row[1:]:
                    held.append(row[1:])
        if held:
            out.extend(work(list(zip(*held, strict=True))))
        yield batch()

    return arrow_map(rows.select("unit", *names).repartition("unit").sortWithinPartitions("unit", "c"), run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(v, label), stored: each end of ``edges`` (a, b) with the smallest vertex of its component."""
    both = materialize(edges.union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        low = labels.join(near, F.col("v") == F.col("a"), "left").select("v", F.col("label").alias("old"), F.least("label", "m").alias("l"))
        jump = labels.select(F.col("v").alias("u"), F.col("label").alias("j"))
        new = materialize(low.join(jump, F.col("l") == F.col("u"), "left").select("v", F.least("l", "j").alias("label"), (F.least("l", "j") < F.col("old")).alias("moved")), "labels")
        discard(labels)
        labels = new
        if new.where("moved").isEmpty():
            discard(both)
            return new


def _linked_in_bands(sets: DataFrame, banded: DataFrame, num: int, den: int) -> DataFrame:
    """(c, component_id), stored: classes of ``sets`` (label, c, rep, n, h), stored, linked band by band, in blocks where needed."""

    def links(rows: DataFrame, names: list[str], tiles: bool = False) -> DataFrame:
        def work(cols: list[tuple]) -> list[tuple]:
            c, sets_ = cols[0], [np.frombuffer(x, _U) for x in cols[1]]
            _, edges = forest(sets_, num, den, list(cols[2]), np.array(cols[3], bool) if tiles else None)
            return [(c[i], c[j]) for i, j in edges]

        return _by_unit(rows, names, work, "a long, b long")

    members = banded.join(sets.select("c", "n").distinct(), "c")
    each = members.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("c").alias("lo"), F.bit_xor(F.xxhash64("c")).alias("x"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("y"))
    once = each.where("m > 1").groupBy("m", "lo", "x", "y").agg(F.min(F.struct("key", "total")).alias("k")).select("k.key", F.ceil(F.col("k.total") / SET_LIMIT).alias("parts"))
    block = F.pmod(F.xxhash64("c", "key"), F.col("parts"))
    groups = materialize(members.join(once, "key").select("key", "c", "n", "parts", block.alias("block")), "groups")
    h = sets.select("c", "h")
    plain = groups.select(F.xxhash64("key", "block").alias("unit"), "c", F.col("c").alias("label")).join(h, "c")
    found = materialize(links(plain, ["c", "h", "label"]), "links")
    cut = groups.where("parts > 1")
    if not cut.isEmpty():
        for last in (False, True):
            labels = components(found)
            at = cut.join(labels.select(F.col("v").alias("c"), "label"), "c", "left").withColumn("label", F.coalesce("label", "c"))
            if not last:  # one member of each block's largest component
                each = at.groupBy("key", "parts", "block", "label").agg(F.count("*").alias("m"), F.min("c").alias("c"))
                lead = each.groupBy("key", "parts", "block").agg(F.max(F.struct("m", "label", "c")).alias("x"))
                rows = lead.select(F.xxhash64("key", F.pmod(F.xxhash64("x.c"), F.ceil(F.col("parts") / 1000))).alias("unit"), F.col("x.c").alias("c"), F.col("x.label").alias("label"))
                more = links(rows.join(h, "c"), ["c", "h", "label"])
            else:  # members outside a band's largest component, with all blocks
                count = at.groupBy("key", "label").agg(F.count("*").alias("m"))
                at = at.join(count.groupBy("key").agg(F.max(F.struct("m", "label")).alias("x")).select("key", F.col("x.label").alias("main")), "key")
                far = at.where("label <> main")
                at = at.join(far.groupBy("key").agg(F.ceil(F.sum("n") / SET_LIMIT).alias("chunks")), "key")
                chunk = F.pmod(F.xxhash64("c", "key", F.lit(1)), F.col("chunks"))
                own = at.select("key", "c", "label", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("far"))
                guest = at.where("label <> main").select("key", "c", "label", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), chunk.alias("chunk"), F.lit(1).alias("far"))
                rows = own.unionByName(guest).select(F.xxhash64("key", "block", "chunk").alias("unit"), "c", "label", "far")
                more = links(rows.join(h, "c"), ["c", "h", "label", "far"], tiles=True)
            joined = materialize(found.union(more), "links")
            discard(found, labels)
            found = joined
    labels = components(found)
    reps = sets.select("c", "rep").distinct().join(labels.select(F.col("v").alias("c"), "label"), "c")
    out = materialize(reps.join(reps.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("c", "component_id"), "linked")
    discard(groups, found, labels)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two sets are linked if den * |intersection| >= num * |union|.
    """
    return _with_component(*_found(docs, k, num, den, bands, rows))


def _found(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, c) of each row, and (c, size, component_id) of classes that aren't a single row alone; both stored."""
    sketched = materialize(_sketched(docs, k, bands, rows), "sketched")
    of = sketched.where("n > 0 and doc_id is not null").groupBy("c", "n")
    firsts = materialize(of.agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands")), "classes")
    classes = firsts.select("c", "n", "rep", "size")
    banded = firsts.select(F.explode("bands").alias("key"), "c")
    shared = banded.groupBy("key").agg(F.min("c").alias("lo"), F.count("*").alias("m")).where("m > 1").select("key", "lo")
    # a class's bands meet at their smallest first members: one edge for the class, and few for those
    least = banded.join(shared, "key").groupBy("c").agg(F.min("lo").alias("b"), F.collect_set("lo").alias("los"))
    clusters = components(least.select(F.explode(F.array_append("los", F.col("c"))).alias("a"), "b").where("a <> b").distinct())
    members = clusters.select("label", F.col("v").alias("c")).join(classes, "c")
    large = materialize(members.groupBy("label").agg(F.sum("n").alias("total")).where(F.col("total") > SET_LIMIT).select("label"), "large")

    def work(cols: list[tuple]) -> list[tuple]:
        c, rep, sets = cols[0], np.array(cols[1]), [np.frombuffer(x, _U) for x in cols[2]]
        if len(c) == 1:
            return []
        comp, _ = forest(sets, num, den)
        least = np.full(len(c), np.iinfo(np.int64).max)
        np.minimum.at(least, comp, rep)
        return list(zip(c, least[comp].tolist(), strict=True))

    small = _with_sets(members.join(large, "label", "left_anti"), docs, k).withColumnRenamed("label", "unit")
    linked = [materialize(_by_unit(small, ["c", "rep", "h"], work, "c long, component_id long"), "linked")]
    if not large.isEmpty():
        sets = materialize(_with_sets(members.join(large, "label"), docs, k), "sets")
        linked.append(_linked_in_bands(sets, banded, num, den))
        discard(sets)
    both = linked[0] if len(linked) == 1 else linked[0].union(linked[1])
    of_class = materialize(classes.join(both, "c", "left").select("c", "size", F.least("rep", "component_id").alias("component_id"), "rep").where("size > 1 or component_id < rep").drop("rep"), "components")
    slim = materialize(sketched.select("doc_id", "n", "c"), "rows")
    discard(sketched, firsts, clusters, large, *linked)
    return slim, of_class


def _with_component(rows_: DataFrame, of_class: DataFrame) -> DataFrame:
    """Rows with their class's component (their own id where ``of_class`` has none); frequent classes, at most 1,000 of them, are broadcast."""
    total = of_class.agg(F.sum("size")).first()[0] or 0
    frequent = F.broadcast(of_class.where(F.col("size") > max(100, total // 1000)).select("c", F.col("component_id").alias("hot")))
    with_hot = rows_.join(frequent, "c", "left")
    rest = with_hot.where("hot is null and c is not null and doc_id is not null").select("doc_id", "n", "c").join(of_class.select("c", "component_id"), "c", "left")
    rest = rest.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    other = with_hot.where("hot is not null or c is null or doc_id is null").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("hot", "doc_id")).alias("component_id"))
    out = rest.union(other)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **how: int) -> DataFrame:
    """Rows of ``docs`` less those whose component has a smaller doc_id; repeats of a row count once."""
    stored = _found(docs.select("doc_id", "text"), **how)
    gone = materialize(_with_component(*stored).where(~F.col("kept")).select(F.col("doc_id").alias("__doc")).distinct(), "gone")
    discard(*stored)
    columns = [f"__{i}" for i in range(len(docs.columns))]  # names of ours can't clash
    left = docs.toDF(*columns).withColumn("__doc", F.col(columns[docs.columns.index("doc_id")]).cast("long")).join(gone, "__doc", "left_anti")
    left = left.withColumn("__th", F.xxhash64(columns[docs.columns.index("text")])).dropDuplicates(["__doc", "__th"])
    return left.select(*columns).toDF(*docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100, bands=25, rows=5)
