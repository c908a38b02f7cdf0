"""Language identification with a blended-spectrum string kernel.

Texts are lower-cased, everything but letters and their marks becomes one blank, and a text is
read in segments of at most ``SEGMENT`` bytes, all of them.  A segment is the set of its byte
n-grams of 1 to ``SPECTRUM`` bytes; the kernel of two sets is the size of their intersection
over the root of the product of their sizes, counted exactly.  Landmarks give the Nyström
features K(x, L) K(L, L)^(-1/2); one ridge regression for each language against the rest is
fitted on them.  Segments are scored by matrix products, batch by batch, and a text by the
mean over its segments, weighted by their sizes.

The classifier is fitted on a sample of every labelled language: about ``PER_CLASS`` rows of
each, by a hash of the id, of each row at most ``PER_TEXT`` segments, spread over the text, and
of each language an equal share of ``TRAIN`` segments, but ``LEAST_TRAIN`` at least.  There are
``LANDMARKS`` landmarks, but ``LEAST_MARKS`` for each language at least.  So the model grows
with the number of languages, and the sample is read in pieces.

A text that is null or has no letter is ``und`` with score 0.  Without any labelled row all
texts are.  Of languages with equal scores the first by name is predicted.  Rows are kept as
often as they come, whatever their ids; an empty table gives an empty result; columns named
lang_pred and score are replaced, others kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, column, discard, materialize, table

SEGMENT, SPECTRUM = 4000, 3
PER_CLASS, PER_TEXT, TRAIN, LEAST_TRAIN, LANDMARKS, LEAST_MARKS = 400, 64, 4096, 256, 128, 4
#: Segments scored at once.
PIECE = 512
RIDGE, SHARPNESS = 1e-2, 8.0
_NOT_LETTERS, _LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")


def segments(text: str | None) -> list[bytes]:
    """The text's letters in pieces, none if it has no letter."""
    if not text or not _LETTER.search(text):
        return []
    data = _NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass")
    n = -(-len(data) // SEGMENT)
    size = -(-len(data) // n)
    return [b" " + data[i * size : (i + 1) * size] + b" " for i in range(n)]


def _grams(part: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(n, codes) of a segment's n-grams, place by place."""
    data = np.frombuffer(part, np.uint8).astype(np.int32)
    code = data
    for n in range(1, SPECTRUM + 1):
        if n > 1:
            code = (code[:-1] << 8) | data[n - 1 :]
        yield n, code


class Spectrum:
    """Intersections of segments with landmarks, by tables of all n-grams of a length."""

    def __init__(self, landmarks: list[bytes]):
        own = [[np.unique(c) for _, c in _grams(x)] for x in landmarks]
        self.sizes = np.array([sum(map(len, x)) for x in own], float)
        every = [np.unique(np.concatenate([x[n] for x in own])) for n in range(SPECTRUM)]
        self.known = sum(map(len, every))
        kind = np.uint16 if self.known < 1 << 16 else np.int32
        self.at, self.seen, first = [], [], 0
        for n in range(SPECTRUM):
            at = np.full(256 ** (n + 1), self.known, kind)  # not in any landmark
            at[every[n]] = np.arange(first, first + len(every[n]))
            first += len(every[n])
            self.at.append(at)
            self.seen.append(np.zeros(256 ** (n + 1), np.uint16))
        self.has = np.zeros((self.known, len(landmarks)), np.uint8)  # which n-gram is in which landmark
        for i, x in enumerate(own):
            for n in range(SPECTRUM):
                self.has[self.at[n][x[n]], i] = 1

    def kernel(self, parts: list[bytes]) -> np.ndarray:
        """K(x, L): a row for each segment."""
        out = np.zeros((len(parts), len(self.sizes)))
        for i, part in enumerate(parts):
            total, rows = 0, []
            for n, code in _grams(part):
                place = np.arange(len(code), dtype=np.uint16)  # segments are shorter than 2^16
                seen = self.seen[n - 1]
                seen[code] = place
                code = code[seen[code] == place]  # each n-gram once, where it comes last
                total += len(code)
                at = self.at[n - 1][code]
                rows.append(at[at < self.known])
            out[i] = np.add.reduce(self.has[np.concatenate(rows)], axis=0, dtype=np.uint16) / np.sqrt(total * self.sizes)
        return out


@dataclass
class KernelClassifier:
    classes: list[str]
    landmarks: list[bytes]
    weights: np.ndarray  # landmarks x classes

    @classmethod
    def fit(cls, counts: dict[str, int], picked: list[bytes], rows: Iterable[tuple[bytes, str]]) -> KernelClassifier:
        """From how many segments each language has, the landmarks, and all segments with their language."""
        classes = sorted(counts)
        at = {c: i for i, c in enumerate(classes)}
        spectrum = Spectrum(picked)
        value, vector = np.linalg.eigh(spectrum.kernel(picked))
        good = value > 1e-6 * value.max(initial=1e-12)
        whiten = vector[:, good] / np.sqrt(value[good])
        total = sum(counts.values())
        share = np.array([total / (len(classes) * counts[c]) for c in classes])
        left, right = RIDGE * np.eye(whiten.shape[1]), np.zeros((whiten.shape[1], len(classes)))
        rows = iter(rows)
        while piece := list(islice(rows, PIECE)):
            phi = spectrum.kernel([x for x, _ in piece]) @ whiten
            label = np.array([at[c] for _, c in piece])
            target = (label[:, None] == np.arange(len(classes))) * 2.0 - 1
            weight = share[label][:, None]
            left += phi.T @ (weight * phi)
            right += phi.T @ (weight * target)
        return cls(classes, picked, whiten @ np.linalg.solve(left, right))


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame) -> KernelClassifier | None:
    """From rows of ``docs`` (doc_id, text, lang) that aren't held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out(), F.lit(False))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    count = rows.groupBy("lang").count()  # a row for each language: a broadcast of the model's size at most
    part = F.lit(float(PER_CLASS)) / F.col("count") * (1 << 20)
    sample = rows.join(F.broadcast(count), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < part).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(column(b, "text"), column(b, "lang"), strict=True):
                parts = segments(text)
                n = min(len(parts), PER_TEXT)
                parts = [parts[i * len(parts) // n] for i in range(n)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), pa.array([lang] * len(parts))], names=["part", "lang"])

    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")
    ranked = arrow_map(sample, run, "part binary, lang string").withColumn("place", F.row_number().over(by_hash))
    found = materialize(ranked.where(F.col("place") <= max(TRAIN, LEAST_TRAIN)), "segments")
    classes = found.where("place = 1").count()
    if not classes:
        discard(found)
        return None
    used = found.where(F.col("place") <= max(-(-TRAIN // classes), LEAST_TRAIN))
    counts = {r["lang"]: r["count"] for r in used.groupBy("lang").count().collect()}
    # in turn from each language
    picked = [bytes(r["part"]) for r in used.where(F.col("place") <= max(LANDMARKS, LEAST_MARKS)).orderBy("place", "lang").limit(max(LANDMARKS, LEAST_MARKS * classes)).collect()]
    model = KernelClassifier.fit(counts, picked, ((bytes(r["part"]), r["lang"]) for r in used.toLocalIterator()))
    discard(found)
    return model


def _predict(texts: list[str | None], m: KernelClassifier | None, spectrum: Spectrum | None) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    parts = [(i, s) for i, t in enumerate(texts) for s in segments(t)] if m else []
    total = np.zeros((len(texts), len(m.classes) if m else 1))
    size = np.zeros(len(texts))
    for a in range(0, len(parts), PIECE):
        at = np.array([i for i, _ in parts[a : a + PIECE]])
        n = np.array([len(s) for _, s in parts[a : a + PIECE]], float)
        np.add.at(total, at, (spectrum.kernel([s for _, s in parts[a : a + PIECE]]) @ m.weights) * n[:, None])
        np.add.at(size, at, n)
    for i in np.flatnonzero(size):
        e = np.exp(SHARPNESS * (total[i] - total[i].max()) / size[i])
        lang[i], score[i] = m.classes[int(e.argmax())], float(e.max() / e.sum())
    return lang, score


def identify(docs: DataFrame, model: KernelClassifier | None) -> DataFrame:
    """``docs`` with lang_pred and score."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(*[c for c in docs.columns if c in ("lang_pred", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        spectrum = Spectrum(m.landmarks) if m else None
        for b in batches:
            lang, score = _predict(column(b, "text"), m, spectrum)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def reject_unclear(docs: DataFrame, model: KernelClassifier | None, least: float) -> DataFrame:
    """Rows of ``docs`` whose language is predicted with a score of at least ``least``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        spectrum = Spectrum(m.landmarks) if m else None
        for b in batches:
            lang, score = _predict(column(b, "text"), m, spectrum)
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
