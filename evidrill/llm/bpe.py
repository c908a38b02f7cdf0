"""BPE encoding and decoding by tree concatenation.

A text of more than ``LEAF`` code points is cut in halves, at any code point, until it isn't
longer; leaves are cut at the blanks where the vocabulary's own pre-tokenizer always cuts, and
their pieces are encoded in batches, in parallel, each distinct piece once a worker.  At each
join a window around the seam is cut and encoded anew and grows until its first and last
pieces are those of the two sides.

A piece that is longer than ``LEAF`` itself, as no blank splits it, goes the same way token by
token: its leaves are encoded as one parallel batch, and at each join a window of tokens grows
until its first tokens repeat the left side's and its last tokens repeat the right side's.  A
BPE sequence is the encoding of its text exactly if every pair of neighbouring tokens is one,
so agreement on both sides makes the joined sequence exact.

Null texts are encoded as the empty text, empty texts have no ids.  Texts of any length are
taken whole.  Rows are kept as often as they come, whatever their ids; an empty table gives an
empty result; columns that clash with an output are replaced, others kept (``encode``,
``decode``) or ignored (``digests``).
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, column, drop_columns, table

#: Code points in a leaf of the tree.
LEAF = 1024
#: Pieces in each of a worker's two generations of remembered pieces.
CACHE = 120_000
#: Below this code point letters, digits and lower case are the same in every library in use.
_SETTLED = "\u0250"
_UNSETTLED = re.compile(f"[{_SETTLED}-\U0010ffff]")
_SUFFIX = b"\xff"  # no UTF-8 text holds this byte; it stands for a vocabulary's word-end mark
#: A blank run that a pre-tokenizer with optional leading blanks does not cut blank by blank.
_LONG_BLANKS = re.compile(r"\s  |  \s|  \Z")

WORD_VOCAB = "word_bpe_49k.json"
BYTE_VOCAB = "byte_bpe_50k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent(dict):
    """Two generations: entries not asked for during a whole generation are forgotten."""

    def __init__(self):
        self.old: dict = {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def age(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()

    def unknown(self, keys) -> set:
        return {x for x in keys if x not in self and x not in self.old}


class TreeEncoder:
    """Encodes whole texts as ``tokenizers`` does with ``add_special_tokens=False``."""

    def __init__(self, path: str, leaf: int = LEAF):
        from tokenizers import Tokenizer

        self.leaf = leaf
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.bare = Tokenizer(self.whole.model)  # one stretch, no normalizer or pre-tokenizer
        added = self.whole.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        # whether blanks are dropped between words, or lead the word that follows
        self.drops_blanks = not self._ids("a b", self.whole)[1:] or self.whole.encode(" a", add_special_tokens=False).ids == self.whole.encode("a", add_special_tokens=False).ids

        self.joins = 0
        self.ranked = None  # encodes settled texts of a vocabulary without normalizer at once
        self.quick = self._rank_encoder(path)

    def _rank_encoder(self, path: str):
        """Encodes one settled piece by the vocabulary's ranks, some times faster; None if its ids aren't in merge order."""
        import json
        import unicodedata

        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, normalizer = spec["model"], spec.get("normalizer")
        mark = model.get("end_of_word_suffix") or ""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        added = set(self.added)

        def raw(token: str) -> bytes:
            end = mark and token.endswith(mark)
            return bytes(byte_of[c] for c in (token[: -len(mark)] if end else token)) + (_SUFFIX if end else b"")

        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        lowercases = normalizer is not None
        if any(a >= b for a, b in zip(order, order[1:], strict=False)) or lowercases != bool(mark):
            return None
        ranks = {raw(t): i for t, i in model["vocab"].items() if t not in added}
        contractions = r"'s|'t|'re|'ve|'m|'ll|'d|"
        pattern = contractions + (r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if mark else r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        by_rank = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode_piece = by_rank._encode_single_piece
        find = regex.compile(pattern).findall
        if not mark:
            self.ranked = by_rank

        def quick(piece: str) -> list[int] | None:
            if max(piece) >= _SETTLED:
                return None
            if lowercases:
                piece = (piece if piece.isascii() else unicodedata.normalize("NFC", piece)).lower()
            if piece.isalpha():
                return encode_piece(piece.encode() + _SUFFIX if mark else piece.encode())
            if not mark and piece[0] == " " and piece[1:].isalpha():
                return encode_piece(piece.encode())
            out: list[int] = []
            for word in find(piece):
                out += encode_piece(word.encode() + _SUFFIX if mark else word.encode())
            return out

        return quick

    @staticmethod
    def _ids(text: str, tokenizer) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    # -- the tree ---------------------------------------------------------------------

    def _spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(id, end) of each token of stretches; encoded as a batch, in parallel."""
        return [[(i, b) for i, (_, b) in zip(e.ids, e.offsets, strict=True)] for e in self.bare.encode_batch(texts, add_special_tokens=False)]

    def stretch(self, text: str) -> list[int]:
        """Ids of one stretch that the pre-tokenizer leaves whole."""
        if len(text) <= self.leaf:
            return self._ids(text, self.bare)
        cuts = [0, *range(self.leaf, len(text), self.leaf)]
        level = [(a, toks) for a, toks in zip(cuts, self._spans([text[a : a + self.leaf] for a in cuts]), strict=True)]
        level = [(a, [(i, a + b) for i, b in toks]) for a, toks in level]
        ends = [*cuts[1:], len(text)]
        level = [(a, e, toks) for (a, toks), e in zip(level, ends, strict=True)]
        while len(level) > 1:
            level = [self._join(text, level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return [i for i, _ in level[0][2]]

    def _join(self, text: str, left: tuple, right: tuple) -> tuple:
        a, seam, lt = left
        _, end, rt = right
        width = 32
        while True:
            # the window starts and ends at token ends of either side
            i = max(0, len(lt) - width)
            j = min(len(rt), width)
            lo = lt[i - 1][1] if i else a
            hi = rt[j - 1][1]
            window = [(k, lo + b) for k, b in self._spans([text[lo:hi]])[0]]
            head_ok = i == 0 or (window and window[0] == lt[i])
            tail = next(((p, q) for p, q in self._agreements(window, rt, j, seam)), None)
            if head_ok and (tail is not None or j == len(rt)):
                if tail is None:
                    return (a, end, lt[:i] + window)
                p, q = tail
                return (a, end, lt[:i] + window[:p] + rt[q:])
            if i == 0 and j == len(rt):
                return (a, end, window)
            width *= 2

    @staticmethod
    def _agreements(window: list, rt: list, j: int, seam: int) -> Iterator[tuple[int, int]]:
        """Places (p, q) beyond the seam where token p of the window is token q of the right side."""
        at = {(rt[q - 1][1], rt[q]): q for q in range(1, j)}
        for p in range(1, len(window)):
            if window[p - 1][1] > seam and (q := at.get((window[p - 1][1], window[p]))) is not None:
                yield p, q

    # -- pieces and texts ---------------------------------------------------------------

    def _long(self, text: str) -> list[int]:
        """A long piece without cuts of ours: the vocabulary's own steps, each long stretch by the tree."""
        if self.whole.normalizer is not None:
            text = self.whole.normalizer.normalize_str(text)
        return [i for word, _ in self.whole.pre_tokenizer.pre_tokenize_str(text) for i in self.stretch(word)]

    def pieces(self, text: str) -> list[str]:
        """Pieces whose encodings, put together, are the text's encoding."""
        if len(text) <= self.leaf:
            return [text[a:b] for a, b in self._cut(text, 0)]
        return [text[a:b] for a, b in self._halves(text, 0, len(text))]

    def _halves(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """Bounds of the pieces of text[a:b]: those of its halves, joined."""
        if b - a <= self.leaf:
            return self._cut(text[a:b], a)
        seam = (a + b) // 2
        left, right = self._halves(text, a, seam), self._halves(text, seam, b)
        self.joins += 1
        n = 2
        while n < max(len(left), len(right)):
            lo, hi = (left[-n][0] if n < len(left) else a), (right[n - 1][1] if n < len(right) else b)
            window = self._cut(text[lo:hi], lo)
            if window and (n >= len(left) or window[0] == left[-n]) and (n >= len(right) or window[-1] == right[n - 1]):
                return left[:-n] + window + right[n:]
            n *= 2
        return self._cut(text[a:b], a)

    def _cut(self, text: str, base: int) -> list[tuple[int, int]]:
        """Bounds of the pieces of a text, counted from ``base``."""
        if self.split_added is not None and "<" in text and self.split_added.search(text):
            out: list[tuple[int, int]] = []
            for part in self.split_added.split(text):
                out += [(base, base + len(part))] if part in self.added else self._cut(part, base) if part else []
                base += len(part)
            return out
        if not self.drops_blanks and _LONG_BLANKS.search(text):
            return [(base, base + len(text))]
        out = []
        lead = 0 if self.drops_blanks else 1  # a blank leads its word, or is dropped
        at = base
        for x in (text.replace("\n", " ") if self.drops_blanks else text).split(" "):
            start = at - lead if at > base else at
            if at + len(x) > start:
                out.append((start, at + len(x)))
            at += len(x) + 1
        return out

    def encode_all(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece; short ones by rank or as batches."""
        out: list[list[int] | None] = [[self.added[x]] if x in self.added else self.quick(x) if self.quick and 0 < len(x) <= self.leaf else None for x in pieces]
        rest = [k for k, x in enumerate(pieces) if out[k] is None and len(x) <= self.leaf]
        for a in range(0, len(rest), 4096):
            for k, e in zip(rest[a : a + 4096], self.whole.encode_batch_fast([pieces[k] for k in rest[a : a + 4096]], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return [self._long(x) if i is None else i for x, i in zip(pieces, out, strict=True)]

    def encode(self, text: str | None) -> list[int]:
        return [i for ids in self.encode_all(self.pieces(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(list(ids), skip_special_tokens=False)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out array<int>``: the ids of each whole text (null: empty)."""
    kept = drop_columns(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in column(b, text)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, out])

    from pyspark.sql import types as T

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with ``out string``: the decoded text of each id list (null: empty)."""
    kept = drop_columns(docs, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([enc.decode(x or []) for x in column(b, ids)], pa.string())], names=[*b.schema.names, out])

    from pyspark.sql import types as T

    return arrow_map(kept, run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def _digest_batches(path: str):
    """Digests of the encodings and decodings, from what each distinct piece contributes to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = TreeEncoder(path)
        plain = enc.whole.decoder is None  # then a decoding is its tokens joined by blanks
        parts = Recent()
        token = [enc.whole.id_to_token(i) or "" for i in range(enc.whole.get_vocab_size())]

        for b in batches:
            for ids, texts in ((column(b, "doc_id")[k : k + 512], column(b, "text")[k : k + 512]) for k in range(0, b.num_rows, 512)):
                split = [enc.pieces(t or "") for t in texts]
                parts.age()
                new = list(parts.unknown(x for p in split for x in p))
                for x, i in zip(new, enc.encode_all(new), strict=True):
                    parts[x] = len(i), " ".join(map(str, i)).encode(), " ".join([token[k] for k in i]).encode() if plain else i
                n, h, d = [], [], []
                for p in split:
                    got = [y for y in map(parts.__getitem__, p) if y[0]]
                    n.append(sum(y[0] for y in got))
                    h.append(hashlib.sha256(b" ".join([y[1] for y in got])).hexdigest())
                    text = b" ".join([y[2] for y in got]) if plain else enc.decode([i for y in got for i in y[2]]).encode()
                    d.append(hashlib.sha256(text).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: token count and digests of ids and decoded text; rows are kept as often as they come."""
    from pyspark.sql import functions as F

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, _digest_batches(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary(WORD_VOCAB))


def texts_to_bytes(enc: TreeEncoder, texts: list[str | None], known: Recent) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of whole texts."""
    out: list[bytes | None] = [None] * len(texts)
    if enc.ranked is not None:
        for i, t in enumerate(texts):
            if not t or (t.isascii() or not _UNSETTLED.search(t)) and not (enc.split_added and "<" in t and enc.split_added.search(t)):
                out[i] = enc.ranked.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if t else b""
    rest = [i for i, x in enumerate(out) if x is None]
    split = [enc.pieces(texts[i] or "") for i in rest]
    known.age()
    new = list(known.unknown(x for p in split for x in p))
    for x, i in zip(new, enc.encode_all(new), strict=True):
        known[x] = struct.pack(f"<{len(i)}I", *i)
    for i, p in zip(rest, split, strict=True):
        out[i] = b"".join(map(known.__getitem__, p))
    return out
