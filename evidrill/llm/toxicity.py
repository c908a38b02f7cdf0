"""Toxicity from the nearest labelled examples.

Words are lower-cased runs of letters; terms are words and beginnings of words.  A bounded sample of labelled texts (about
``PER_CLASS`` of either label, by a hash of the id, equal texts once) gives the terms and the
examples.  Every term is kept that toxic examples hold far oftener (likelihood ratio and
G-statistic), so the space is a selected one, with no limit on its size.

A text is its TF-IDF vector over these terms, with document frequencies of all documents, and
one more term that every text holds, so that the number of terms met counts beside which
they are.  Examples with equal vectors are one entry with its votes.  Entries lie in an
inverted index in blocks of ``BLOCK`` with the largest weight of each term in each block.  A
query visits blocks by descending bound and stops once the bound is below the last neighbour
it needs: the neighbours are exact, ties included.  Votes are weighted by a power of the
cosine and by how many labelled rows an example stands for, so scores are calibrated; the
example nearest to the text is the evidence.

Null and empty texts are scored as texts without terms.  Without any label the score is 0.
Rows that repeat a doc_id are scored one by one; of several labels of an id the larger counts,
and equal texts are one example, toxic if one of their rows is.  An empty table gives an empty
result.  ``fit`` and ``score_rows`` ignore other columns, ``reject_toxic`` keeps them.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, column, discard, materialize, table

PER_CLASS, BLOCK, NEIGHBOURS, POWER, PRIOR = 3000, 64, 25, 4, 1.0
LEAST_DF, LEAST_RATIO, LEAST_G = 5, 4.0, 15.0
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the beginnings of words that are terms beside the words.
HEADS = (4, 5, 6)


def terms_of(word: str) -> list[str]:
    """The terms that an occurrence of a word counts for: the word, and its beginnings (marked by a hyphen)."""
    return [word, *(word[:n] + "-" for n in HEADS if len(word) > n)]


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def heads_of(terms: dict[str, int]) -> set[str]:
    """How the terms begin: most words begin like none of them."""
    return {t.rstrip("-")[: HEADS[0]] for t in terms}


def counts_of(text: str | None, terms: dict[str, int], heads: set[str]) -> Counter:
    """How often a text holds each term."""
    return Counter(terms[t] for w in words(text) if w[: HEADS[0]] in heads for t in terms_of(w) if t in terms)


@dataclass
class Index:
    """Block-max inverted index of distinct example vectors (unit length)."""

    votes: list[tuple[float, float, int]]  # of each entry: weight for, weight against, an example's id
    sizes: list[int]
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)  # by block
    most: dict[int, np.ndarray] = field(default_factory=dict)  # of each term, by block

    @classmethod
    def build(cls, vectors: list[dict[int, float]], votes: list[tuple[float, float, int]], sizes: list[int]) -> Index:
        index = cls(votes, sizes)
        blocks = -(-len(vectors) // BLOCK)
        most: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(blocks))
        for b in range(blocks):
            rows: dict[int, list[tuple[int, float]]] = defaultdict(list)
            for i, v in enumerate(vectors[b * BLOCK : (b + 1) * BLOCK]):
                for t, w in v.items():
                    rows[t].append((i, w))
                    most[t][b] = max(most[t][b], w)
            index.postings.append({t: (np.array([i for i, _ in r]), np.array([w for _, w in r])) for t, r in rows.items()})
        index.most = dict(most)
        return index

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[float, int]]:
        """(cosine, entry), best first: entries that hold the k nearest examples, and all that tie with the last."""
        bound = np.zeros(len(self.postings))
        for t, w in query.items():
            if t in self.most:
                bound += w * self.most[t]
        found: list[tuple[float, int]] = []
        last = -1.0
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < last - 1e-12:
                break
            score = np.zeros(BLOCK)
            for t, w in query.items():
                if t in self.postings[b]:
                    at, weight = self.postings[b][t]
                    score[at] += w * weight
            found += [(round(float(s), 12), int(b) * BLOCK + i) for i, s in enumerate(score) if s >= last - 1e-12 and b * BLOCK + i < len(self.sizes)]
            found.sort(key=lambda x: (-x[0], x[1]))
            held = 0
            for n, (s, e) in enumerate(found):
                held += self.sizes[e]
                if held >= k:
                    last = s
                    found = [x for x in found[: n + 1]] + [x for x in found[n + 1 :] if x[0] == s]
                    break
        return found


@dataclass
class Model:
    terms: dict[str, int]
    idf: list[float]  # by term; the last is that of the term that every text holds
    index: Index
    base: float
    cache: dict[tuple, tuple[float, int]] = field(default_factory=dict)

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()}
        v[len(self.terms)] = self.idf[-1]
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    def score(self, counts: dict[int, int]) -> tuple[float, int]:
        key = tuple(sorted(counts.items()))
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            near = self.index.nearest(self.vector(counts), NEIGHBOURS)
            yes = no = 0.0
            for c, e in near:
                w = max(c, 0.0) ** POWER
                yes, no = yes + w * self.index.votes[e][0], no + w * self.index.votes[e][1]
            share = PRIOR
            self.cache[key] = min(1.0, max(0.0, (yes + share * self.base) / (yes + no + share))), self.index.votes[near[0][1]][2] if near else -1
        return self.cache[key]


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[int]]:
    """(doc_id, toxic, text) of the sample, and how many labelled rows either label has."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    counts = [n.get(0, 0), n.get(1, 0)]
    part = [min(1.0, PER_CLASS / max(c, 1)) for c in counts]
    limit = F.when(F.col("toxic") == 1, F.lit(part[1])).otherwise(F.lit(part[0])) * (1 << 20)
    ids = materialize(known.where(F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) < limit), "sample")
    # about PER_CLASS ids of either label: a bounded broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id")
    out = materialize(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic", "text"), "examples")
    discard(ids)
    return out, counts


def _statistics(sample: DataFrame) -> DataFrame:
    """(term, bad, good): in how many toxic and other texts of the sample each word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = Counter[str](), Counter[str]()
        for b in batches:
            for text, toxic in zip(column(b, "text"), column(b, "toxic"), strict=True):
                df[toxic].update({t for w in set(words(text)) for t in terms_of(w)})
        terms = list(df[0].keys() | df[1].keys())
        for a in range(0, len(terms), 50_000):
            t = terms[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array([df[1][x] for x in t], pa.int64()), pa.array([df[0][x] for x in t], pa.int64())], names=["term", "bad", "good"])

    return arrow_map(sample.select("text", "toxic"), run, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _g(a: int, b: int, n1: int, n0: int) -> float:
    """G-statistic of a term in a of n1 toxic and b of n0 other texts."""
    total = 0.0
    for o, n, m in ((a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)):
        if o:
            total += 2 * o * math.log(o * (n1 + n0) / (n * m))
    return total


def _terms(sample: DataFrame) -> list[str]:
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return []
    rare = F.lit(LEAST_RATIO) * (F.col("good") + 0.5) / (n0 + 1)
    able = _statistics(sample).where((F.col("bad") >= LEAST_DF) & ((F.col("bad") + 0.5) / (n1 + 1) >= rare))
    able = able.collect()  # each in LEAST_DF toxic texts of the sample at least
    chosen = sorted(((_g(r["bad"], r["good"], n1, n0), r["term"]) for r in able), key=lambda x: (-x[0], x[1]))
    return [t for g, t in chosen if g >= LEAST_G]


def _counted(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``docs`` with ``terms array<long>`` in place of text: term << 32 | count, by term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        heads = heads_of(known)
        for b in batches:
            out = []
            for text in column(b, "text"):
                out.append([t << 32 | c for t, c in sorted(counts_of(text, known, heads).items())])
            cols = list(b.columns)
            cols[at] = pa.array(out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:at], "terms", *b.schema.names[at + 1 :]])

    from pyspark.sql import types as T

    fields = list(docs.schema.fields)
    fields[at] = T.StructField("terms", T.ArrayType(T.LongType()))
    return arrow_map(docs, run, T.StructType(fields))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame]:
    """The model, and (doc_id, terms) of all of ``docs``, stored."""
    docs = docs.select("doc_id", "text")
    sample, counts = _sample(docs, labels)
    terms = {t: i for i, t in enumerate(_terms(sample))}
    rows = materialize(_counted(docs, terms), "terms")
    examples = materialize(_counted(sample, terms), "examples")
    total = rows.count()
    df = {r["t"]: r["count"] for r in rows.select(F.explode("terms").alias("x")).groupBy(F.shiftright("x", 32).alias("t")).count().collect()}
    idf = [math.log(1 + total / max(df.get(i, 0), 1)) for i in range(len(terms))] + [math.log(2)]
    n = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    entries = examples.groupBy("terms").agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.count("*").alias("all"), F.min("doc_id").alias("example")).collect()  # the sample at most
    discard(sample, examples)
    if not entries:
        return None, rows
    per = [counts[c] / max(n.get(c, 0), 1) for c in (0, 1)]
    model = Model(terms, idf, Index([], []), counts[1] / max(sum(counts), 1))
    entries.sort(key=lambda r: list(r["terms"]))
    vectors = [model.vector({x >> 32: x & 0xFFFFFFFF for x in r["terms"]}) for r in entries]
    mean = max(sum(counts) / max(sum(n.values()), 1), 1e-9)
    votes = [(r["bad"] * per[1] / mean, (r["all"] - r["bad"]) * per[0] / mean, r["example"]) for r in entries]
    model.index = Index.build(vectors, votes, [r["all"] for r in entries])
    return model, rows


def score_rows(rows: DataFrame, model: Model | None) -> DataFrame:
    """Counted ``rows`` with score, predicted and evidence (the doc_id of the nearest example)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in rows.schema.fields if f.name != "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.score({x >> 32: x & 0xFFFFFFFF for x in t}) if m else (0.0, None) for t in column(b, "terms")]
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            cols += [pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([e for _, e in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in kept), "score", "predicted", "evidence"])

    from pyspark.sql import types as T

    return arrow_map(rows, run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.LongType())]))


def reject_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of ``docs`` whose text isn't predicted toxic, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        heads = heads_of(m.terms) if m else set()
        for b in batches:
            keep = [m is None or m.score(dict(counts_of(text, m.terms, heads)))[0] < 0.5 for text in column(b, "text")]
            yield b.filter(pa.array(keep, pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rows = fit(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_rows(rows, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
