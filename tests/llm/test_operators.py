import hashlib
import math
import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrill.llm import bpe, html, langid, minhash, ngram, packing, suffix, topk, toxicity, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string"


def prose(r, n, words=400):
    return " ".join("w%d" % int(words * r.random() ** 2) for _ in range(n))


def corpus(spark, n=40, seed=1, extra=()):
    """Texts with exact and near copies, shared passages, nulls, empty and repeated rows, clashing columns."""
    r = random.Random(seed)
    passage = prose(r, 60)
    texts = [prose(r, r.choice([1, 2, 5, 80, 200])) for _ in range(n)]
    for i in range(0, n, 7):
        texts[i] = prose(r, 40) + " " + passage + " " + prose(r, 30)
    texts[5], texts[9] = texts[3], texts[3]
    texts[11] = texts[12] + " tail"
    texts += [None, "", "   ", "Ünï çødé 日本語 😀 " * 9, "aaaa" * 200, texts[0]]
    rows = [(10 * i + 3, t, "xx", "s", len(t or ""), 0.5, "i") for i, t in enumerate(texts)] + list(extra)
    r.shuffle(rows)
    return spark.createDataFrame(rows + [rows[0]], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- BPE --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", [bpe.WORD_VOCAB, bpe.BYTE_VOCAB])
def test_bpe_equals_the_library(name):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(bpe.vocabulary(name)), random.Random(2)
    for leaf in (8, 48, bpe.LEAF):
        e = bpe.TreeEncoder(bpe.vocabulary(name), leaf)
        texts = ["", "  a", "a   b", "a \n  b", "x<|endoftext|> y  <|startoftext|>", "İSTANBUL Σας", "a   b", "don't  stop  ", "日本語" * 50, "²½ ٣", "a\tb\r\nc  \n", "ß" * 500, "ab" * 400 + " c"]
        texts += ["".join(r.choice("thaeinosr é,1 ") for _ in range(r.randint(1, 600))) for _ in range(60)]
        texts += ["".join(r.choice("thaeinosr") for _ in range(700)) for _ in range(20)]
        texts += ["".join(r.choice("ab .,\t\n\r\x0b\x0c\x1c\x1f\x85\xa0\xad\u0149\u01c5\u024f\xaa\xb2\xbc'<1é") for _ in range(r.randint(1, 200))) for _ in range(300)]
        ids = bpe.texts_to_bytes(e, [None, *texts], bpe.Recent())
        assert ids[0] == b"" and [np.frombuffer(x, "<u4").tolist() for x in ids[1:]] == [t.encode(x, add_special_tokens=False).ids for x in texts]
        for x in texts:
            assert e.encode(x) == t.encode(x, add_special_tokens=False).ids, x[:40]
            assert e.decode(e.encode(x)) == t.decode(t.encode(x, add_special_tokens=False).ids, skip_special_tokens=False)


def test_whole_texts_are_joined_by_the_tree(spark):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for name in (bpe.WORD_VOCAB, bpe.BYTE_VOCAB):
        t, e = Tokenizer.from_file(bpe.vocabulary(name)), bpe.TreeEncoder(bpe.vocabulary(name))
        assert all(e.encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)
        assert e.joins > len([x for x in texts if len(x) > bpe.LEAF]) > 20


def test_bpe_rows(spark):
    from tokenizers import Tokenizer

    t, path = Tokenizer.from_file(bpe.vocabulary(bpe.WORD_VOCAB)), bpe.vocabulary(bpe.WORD_VOCAB)
    docs = corpus(spark)
    assert bpe.digests(docs, path).count() == docs.count() and bpe.digests(empty(spark), path).count() == 0
    got = by_id(bpe.digests(docs, path))
    for r in docs.collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert g["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert all(r["decoded"] == t.decode(list(r["ids"]), skip_special_tokens=False) for r in back)


# -- packing ----------------------------------------------------------------------------------


def test_plan_places_every_piece_once():
    r = random.Random(0)
    for _ in range(60):
        c = r.choice([10, 30, 100, 1024])
        counts = {r.randint(1, c - 1): r.randint(1, r.choice([3, 300])) for _ in range(r.randint(1, 40))}
        at, ranks = defaultdict(list), defaultdict(list)
        for s, first, n, base, offset in packing.plan(counts, c):
            ranks[s] += range(first, first + n)
            for i in range(n):
                at[base + i].append((offset, s))
        assert all(sorted(ranks[s]) == list(range(n)) for s, n in counts.items())
        for items in at.values():
            end = 0
            for offset, s in sorted(items):
                assert offset == end
                end += s
            assert end <= c
        free: list[int] = []  # plain best-fit decreasing
        for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
            i = bisect_left(free, s)
            insort(free, (free.pop(i) if i < len(free) else c) - s)
        assert len(at) <= 1.02 * len(free) + 1


def test_packed_documents(spark):
    docs = corpus(spark)
    path = bpe.vocabulary(bpe.BYTE_VOCAB)
    rows = packing.pack_documents(docs, path, capacity=64).collect()
    e, where = bpe.TreeEncoder(path), defaultdict(list)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = {k: e.encode(v) + [packing.END] for k, v in text.items()}
    for r in rows:
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] <= 64 and (r["piece"] == 0 or r["length"] == 64)
        assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())
        where[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(ids[r["doc_id"]]) for r in docs.collect())
    for items in where.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= 64
    assert packing.pack_documents(empty(spark), path).count() == 0


# -- repeats ----------------------------------------------------------------------------------


def brute_repeats(docs, length):
    seen, out = set(), {}
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if b[s : s + length] in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(b[s : s + length])
        out[doc] = bytes(gone)
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    for cut, index in ((suffix.SLICE, suffix.CROWDED), (500, 300)):  # long texts are read in slices; crowded anchors string by string
        monkeypatch.setattr(suffix, "SLICE", cut)
        monkeypatch.setattr(suffix, "CROWDED", index)
        docs = corpus(spark, 50, 3)
        rows = sorted({(r["doc_id"], r["text"]) for r in docs.collect()}, key=lambda x: x[0])
        gone = brute_repeats(rows, 100)
        got = by_id(suffix.remove_repeats(docs))
        assert suffix.remove_repeats(docs).count() == docs.count()
        for doc, text in rows:
            b, g = (text or "").encode(), got[doc]
            kept = bytes(c for c, x in zip(b, gone[doc], strict=True) if not x)
            assert (g["n_bytes"], g["n_removed"], g["kept_sha256"]) == (len(b), sum(gone[doc]), hashlib.sha256(kept).hexdigest())
            assert g["n_spans"] == len(re.findall(b"\1+", gone[doc]))
    assert suffix.remove_repeats(empty(spark)).count() == 0
    left = suffix.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect() if r["text"] is not None)


def test_repeated_rows_keep_their_first_copy(spark):
    r = random.Random(11)
    a, b = prose(r, 80, 5000), prose(r, 80, 5000)
    rows = [(1, a)] * 3 + [(2, "x" + a[:150] + " other " + a[200:] + "y")] * 2 + [(None, b)] * 3 + [(None, b[:130] + " and an end")] * 2 + [(7, prose(r, 60, 5000))] * 2
    for n in (1, 5):  # copies in one task, and in several
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["kept_sha256"]) for x in suffix.remove_repeats(docs).collect())
        order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))
        # of the rows without an id the hash of the text decides which is earlier
        th = {x["text"]: x["th"] for x in docs.select("text", F.xxhash64(F.col("text").cast("binary")).alias("th")).distinct().collect()}
        order.sort(key=lambda x: (x[0] is None, x[0] or 0, th[x[1]]))
        gone = brute_repeats(list(enumerate(t for _, t in order)), 100)
        want = Counter()
        for i, (doc, t) in enumerate(order):
            kept = bytes(c for c, x in zip(t.encode(), gone[i], strict=True) if not x)
            want[(doc, len(t), sum(gone[i]), hashlib.sha256(kept).hexdigest())] += rows.count((doc, t))
        assert got == want


def test_run_length_index_finds_earlier_strings():
    r = random.Random(5)
    for _ in range(30):
        base = bytes(r.choice(b"ab\0") for _ in range(40))
        texts = [base[r.randint(0, 9) :] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 20))) for _ in range(r.randint(1, 12))]
        depth, seen, want = 6, set(), []
        for t in texts:
            hit = []
            for s in range(len(t) - depth + 1):
                if t[s : s + depth] in seen:
                    hit.append(s)
                seen.add(t[s : s + depth])
            want.append(hit)
        index = suffix.RunLengthIndex(texts)
        assert [h.tolist() for h in index.repeated(depth)] == want
        assert len(index.starts) == len(index.ends) == len(index.at) <= index.n
        data, place = [], []
        for i, t in enumerate(texts):
            data += [*((1, c) for c in t), (0, i)]
        order = sorted(range(len(data)), key=lambda i: data[i:])
        before, common = index.statistics(0, len(data))
        for a, b in zip(order, order[1:], strict=False):
            n = 0
            while max(a, b) + n < len(data) and data[a + n] == data[b + n]:
                n += 1
            place.append((before[b], common[b]) == (a, n))
        assert all(place) and before[order[0]] == -1


# -- fingerprints -----------------------------------------------------------------------------


def test_winnowing_keeps_its_guarantee(spark):
    docs = corpus(spark).where("text is not null").dropDuplicates(["doc_id"])
    rows = winnow.with_entries(docs, "text", "entries").select("doc_id", "text", "entries", winnow.printed("entries").alias("p")).collect()
    same = defaultdict(set)
    for r in rows:
        same[r["text"]].add(r["p"])
        n = len(re.findall(r"[^\W_]{1,16}|[^\s\w]{1,16}|_+", r["text"].lower()))
        at = sorted(16777215 - (e & 16777215) for e in r["entries"])
        grams = max(n - winnow.K + 1, min(n, 1))
        assert (len(at) > 0) == (n > 0)
        gaps = np.diff([-1, *at, grams]) if at else []
        assert all(g <= winnow.W for g in gaps)  # every window of W hashes holds a chosen one
    assert all(len(v) == 1 for v in same.values())


def test_winnowing_query(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -r[0])
    got = winnow.op5_winnowing(spark, str(tmp_path)).collect()
    want = Counter()
    for i, (doc, t) in enumerate(rows):
        m = len(t) // 3
        e = t[: len(t) - m] + rows[(i + 1) % len(rows)][1][:m]
        want[(doc, len(t), hashlib.sha256(e.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    empty(spark).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert winnow.op5_winnowing(spark, str(tmp_path / "none")).count() == 0


def test_winnowing_of_short_texts_and_long_runs(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = []
    for i in range(600):
        n = 2 + i % 40
        w = [word() for _ in range(n)]
        rows.append((i, " ".join(w), " ".join(w[: n - max(n // 3, 1)] + [word() for _ in range(max(n // 3, 1))])))
    for i in range(40):  # the same passage at other offsets of a run without blanks
        passage = "".join(r.choice("abcdefghij") for _ in range(60))
        rows.append((1000 + i, word() * 9 + passage + word() * 5, word() * 9 + "q" * (1 + i % 15) + passage + word() * 3))
        rows.append((2000 + i, "=-+*"[i % 4] * 40 + "<>#%&$~^|/" * 4, "<>#%&$~^|/" * 4 + "!" * 30))
    both = winnow.with_entries(winnow.with_entries(spark.createDataFrame(rows, "i long, a string, b string"), "a", "x"), "b", "y")
    got = winnow.with_likeness(both.withColumns({"x": winnow.hashes("x"), "y": winnow.hashes("y")}), "x", "y", "near").collect()
    assert [(x["i"], x["a"]) for x in got if x["near"] == 0] == []


# -- language model ---------------------------------------------------------------------------


def test_scores_equal_brute_force(spark):
    docs = corpus(spark, 25, 6)
    rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))) for r in docs.collect()]
    own = [[Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) for n in range(4)] for _, w in rows]
    all_ = [sum((o[n] for o in own), Counter()) for n in range(4)]
    total, want = sum(len(w) for _, w in rows), []
    for (doc, w), o in zip(rows, own, strict=True):
        c = lambda g, o=o: all_[len(g)][g] - o[len(g)][g]
        s = 0.0
        for j in range(len(w)):
            a = tuple(w[max(0, j - 2) : j + 1])
            if len(a) == 3 and c(a) > 0 and c(a[:2]) > 0:
                p = c(a) / c(a[:2])
            elif j and c(a[-2:]) > 0 and c(a[-2:-1]) > 0:
                p = 0.4 * c(a[-2:]) / c(a[-2:-1])
            else:
                p = 0.16 * c(a[-1:]) / (total - len(w)) if c(a[-1:]) > 0 else 0.16 / (total - len(w) + 1)
            s += math.log10(p)
        want.append((doc, len(w), round(s, 6)))
    got = ngram.score(docs).collect()
    assert sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in got) == sorted(want)
    assert ngram.score(empty(spark)).count() == 0


# -- near duplicates --------------------------------------------------------------------------


def brute_components(rows, k, num, den):
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_components_equal_brute_force(spark, monkeypatch):
    r = random.Random(8)
    base = prose(r, 150, 5000).split()
    variants = []
    for i in range(60):  # near copies of a text, whose copies are mostly no near copies of each other
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(150)] = f"new{r.randrange(40)}"
        variants.append((5000 + i, " ".join(w), "xx", "s", 0, 0.0, ""))
    docs = corpus(spark, 40, 9, variants)
    want = brute_components([(x["doc_id"], x["text"]) for x in docs.collect()], 3, 85, 100)
    for limit in (minhash.SET_LIMIT, 2000):  # whole clusters; band by band, in blocks
        monkeypatch.setattr(minhash, "SET_LIMIT", limit)
        got = minhash.near_duplicates(docs, 3, 85, 100, 25, 5).collect()
        assert len(got) == docs.count()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == left.select("doc_id").distinct().count()
    assert minhash.near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "x y z w")], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in minhash.near_duplicates(odd).collect()) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_forest_equals_brute_force():
    r = np.random.default_rng(5)
    for turn in range(30):
        base = r.integers(0, 200, 40)
        sets = [np.unique(np.where(r.random(40) < r.choice([0.02, 0.1, 0.5]), r.integers(0, 400, 40), base)).astype(np.uint64) for _ in range(30)]
        linked = lambda a, b, s=sets: 100 * len(np.intersect1d(s[a], s[b])) >= 80 * len(np.union1d(s[a], s[b]))
        side = r.integers(0, 2, 30).astype(bool) if turn % 2 else None
        comp, edges = minhash.forest(sets, 80, 100, None, side)
        parent = list(range(30))
        for a, b in combinations(range(30), 2):
            if linked(a, b) and (side is None or side[a] != side[b]):
                x, y = parent[a], parent[b]
                parent = [x if p == y else p for p in parent]
        assert all((comp[a] == comp[b]) == (parent[a] == parent[b]) for a, b in combinations(range(30), 2))
        assert len(edges) == 30 - len(set(parent)) and all(linked(a, b) for a, b in edges)


def test_near_duplicates_of_very_long_texts_and_clashing_columns(spark):
    r = random.Random(3)
    long = prose(r, 120_000, 50_000)
    rows = [(1, long, 1, "a"), (2, long + " tail", 2, "b"), (3, prose(r, 120_000, 50_000), 3, "c"), (4, None, 4, "d"), (5, "", 5, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc int, component_id string")
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and {x["doc_id"]: x["component_id"] for x in left.collect()} == {1: "a", 3: "c", 4: "d", 5: "e"}


def test_sketch_estimates_likeness():
    r = np.random.default_rng(3)
    for n in (1, 5, 50, 3000):
        h = r.integers(1, 1 << 63, n).astype(np.uint64)
        a = minhash.sketch(h, 128)
        assert (a != np.iinfo(np.uint64).max).all() and (a == minhash.sketch(h[::-1].copy(), 128)).all()
    x = r.integers(1, 1 << 63, 1000).astype(np.uint64)
    agree = [(minhash.sketch(x[:900] + np.uint64(i), 128) == minhash.sketch(x[100:] + np.uint64(i), 128)).mean() for i in range(30)]
    assert abs(np.mean(agree) - 0.8) < 0.03


# -- top-k ------------------------------------------------------------------------------------


def test_top_inner_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "STEP", 16)
    monkeypatch.setattr(topk, "QUERY_CELLS", 40)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1 + i % 3) for _ in range(20)]) for i in range(300)] + [(300, [0.0] * 20), (301, None), (302, [float("nan")] * 20), (303, [None, 1.0]), (None, [1.0] * 20), (500, [1.0] * 20), (501, [1.0] * 20), (502, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.integers(df, "vec_id", "embedding")
    got = topk.top_inner_products(v.where("id % 100 = 0"), v, 10).collect()
    ints = {x["id"]: list(x["v"]) + [0] * (20 - len(x["v"])) for x in v.collect()}
    assert set(ints) == {*range(301), 500, 501, 502}
    want = []
    for q in (0, 100, 200, 300, 500):
        best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c], strict=True)), c) for c in ints if c != q)[:10]
        want += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)
    with pytest.raises(ValueError):
        topk.top_inner_products(v, v.withColumn("v", F.expr("transform(v, x -> 1L << 40)")), 10)
    none = topk.integers(df.limit(0), "vec_id", "embedding")
    assert topk.top_inner_products(none, none, 10).count() == 0


# -- classifiers ------------------------------------------------------------------------------


def test_language_of_held_out_texts(spark):
    r = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["zu", "xy", "qu"], "cc": ["ér", "ñà", "ço"]}
    rows = []
    for i in range(240):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.choice([3, 30, 3000 if i < 6 else 50]))), lang, "s", 0, 0.0, ""))
    rows += [(900, None, "aa", "s", 0, 0.0, ""), (901, "", None, "s", 0, 0.0, ""), (902, "12 ... 34", "aa", "s", 0, 0.0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = langid.identify(docs, langid.fit(docs)).withColumn("h", langid.held_out()).collect()
    assert all(x["lang_pred"] == x["lang"] for x in found if x["h"] and x["doc_id"] < 900)
    assert all((x["lang_pred"], x["score"]) == ("und", 0.0) for x in found if x["doc_id"] >= 900)
    assert all(0 <= x["score"] <= 1 for x in found)
    assert langid.fit(empty(spark)) is None and langid.identify(docs, None).where("lang_pred <> 'und'").count() == 0


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN", 64)  # fewer than the long text has segments
    monkeypatch.setattr(langid, "LEAST_TRAIN", 8)
    r, rows = random.Random(4), []
    parts = [[chr(0x4E00 + 40 * c + j) for j in range(8)] for c in range(80)]
    for i in range(1600):
        rows.append((i, " ".join("".join(r.choice(parts[i % 80]) for _ in range(3)) for _ in range(12)), f"l{i % 80:02}"))
    first = next(i for i in range(0, 1600, 80) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows[first] = (first, " ".join("".join(r.choice(parts[0]) for _ in range(3)) for _ in range(100_000)), "l00")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.classes) == 80
    found = langid.identify(docs, model).where(langid.held_out()).collect()
    assert all(x["lang_pred"] == x["lang"] and x["score"] >= 0.3 for x in found), [(x["lang"], x["lang_pred"], x["score"]) for x in found][:5]


def test_toxicity_of_held_out_texts(spark):
    r = random.Random(2)
    bad = ["vilexo", "vilena", "grumpf"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 6 == 0)
        w = ["".join(r.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(3)) for _ in range(r.choice([20, 60]))]
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w), "xx", "s", 0, 0.0, ""))
        labels.append((i, 1, toxic))
    rows += [(900, None, "xx", "s", 0, 0.0, ""), (901, "", "xx", "s", 0, 0.0, ""), rows[0]]
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model, counted = toxicity.fit(docs, known)
    assert set(bad) <= set(model.terms)
    got = toxicity.score_rows(counted, model).withColumn("h", toxicity.held_out()).collect()
    assert len(got) == len(rows)
    assert all(x["predicted"] == int(x["doc_id"] % 6 == 0) for x in got if x["doc_id"] < 600 and x["h"])
    assert all(0 <= x["score"] < 0.5 for x in got if x["doc_id"] >= 900)
    left = toxicity.reject_toxic(docs, model)
    assert left.columns == docs.columns and left.where("doc_id < 600 and doc_id % 6 = 0").count() == 0 and left.where("doc_id >= 900").count() == 2
    none, counted = toxicity.fit(docs, known.limit(0))
    assert none is None and toxicity.score_rows(counted, none).where("score <> 0").count() == 0


def test_toxicity_keeps_every_term_that_passes(spark):
    r = random.Random(7)
    plain = ["".join(r.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(3)) for _ in range(60)]
    bad = ["zo" + "".join(r.choice("bdfghjr") + r.choice("aeiou") for _ in range(3)) + f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    copied = "vilexo grumpf snarlo"  # always in the same passage
    rows, labels = [], []
    for i in range(800):
        w = [r.choice(plain) for _ in range(20)]
        if i % 2:
            w += [copied] if i < 120 else [bad[(i * 15 + j) % 300] for j in range(30)]
        rows.append((i, " ".join(w)))
        labels.append((i, 1, i % 2))
    rows += [(2000 + i, " ".join([r.choice(plain) for _ in range(10)] + [x] * 3)) for i, x in enumerate(bad)]
    rows += [(3000, " ".join(plain[:12]) + " " + copied)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, _ = toxicity.fit(docs, known)
    assert set(bad) | set(copied.split()) <= set(model.terms)
    assert {x["doc_id"] for x in toxicity.reject_toxic(docs, model).where("doc_id >= 800").collect()} == set()


def test_block_max_search_is_exact():
    r = random.Random(3)
    vectors = []
    for _ in range(500):
        v = {t: r.random() for t in r.sample(range(30), r.randint(1, 5))}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({t: x / n for t, x in v.items()})
    index = toxicity.Index.build(vectors, [(1.0, 0.0, i) for i in range(500)], [1] * 500)
    for q in vectors[:40]:
        cos = [round(sum(w * v.get(t, 0) for t, w in q.items()), 12) for v in vectors]
        cut = sorted(cos, reverse=True)[24]
        assert {e for _, e in index.nearest(q, 25)} == {i for i, c in enumerate(cos) if c >= cut}


# -- pages ------------------------------------------------------------------------------------


def test_main_text_of_held_out_layouts():
    model = html.TreeModel.fit(html.training_pages())
    right = total = 0
    for page, state in html.training_pages(80, 99):
        content = model.marginals(page)
        right += sum((content[i] >= 0.5) == bool(state[i]) for i, _ in page.runs)
        total += len(page.runs)
    assert right > 0.97 * total


def test_main_text_of_a_page(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav>
    <div class="ad">Buy &amp; save now.</div><article><h1>One  title</h1><p><b>First &eacute;
    text, long enough.<br><p>Second.<form><label>Mail</label><input></form></article><footer>&copy; x</footer>"""
    rows = spark.createDataFrame([(1, "u", page, "old"), (2, "u", None, ""), (3, "u", "", ""), (4, "u", "<p>a<b>c</p>d</b><<<", "")], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(rows).collect()}
    assert got[1] == "One title\n\nFirst é text, long enough.\n\nSecond." and got[2] == got[3] == ""
    assert html.extract(rows.limit(0)).count() == 0


def test_messages_give_exact_marginals():
    model = html.TreeModel.fit(html.training_pages(60))
    page = html.parse('<body><div class=content><p>Some text.</p><ul><li><a href=x>l</a></ul></div><div class=ad>x</div></body>')
    local = []
    for n in page.nodes:
        got = [model.unary[f] for f in html.features(n) if f in model.unary]
        local.append([sum(g[s] for g in got) for s in (0, 1)])
    mass = [[0.0, 0.0] for _ in page.nodes]
    for bits in range(1 << len(page.nodes)):
        s = [bits >> i & 1 for i in range(len(page.nodes))]
        w = math.exp(model.root[s[0]] + sum(local[i][s[i]] for i in range(len(s))) + sum(model.pair[s[n.parent]][s[i]] for i, n in enumerate(page.nodes) if i))
        for i, x in enumerate(s):
            mass[i][x] += w
    assert np.allclose(model.marginals(page), [m[1] / sum(m) for m in mass])


# -- answers against plain versions -----------------------------------------------------------


def brute_entries(text):
    import regex
    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tokens = []
    for run in regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0b\f\r ]+", (text or "").lower()):
        tokens += [run] if len(run) <= 16 else [run[i : i + 16] for i in range(len(run) - 15)]
    each = [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]

    def grams(n):
        out = []
        for i in range(len(each) - n + 1):
            h = 42
            for x in each[i : i + n]:
                h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
            out.append(signed((h & ~0xFFFFFF & (1 << 64) - 1) | (0xFFFFFF - i)))
        return out

    if len(each) < 2 * (winnow.W + winnow.K - 1):
        return [e for n in range(1, winnow.K + 1) for e in grams(n)]
    g = grams(winnow.K)
    return list(dict.fromkeys(min(g[i : i + winnow.W]) for i in range(len(g) - winnow.W + 1)))


def test_fingerprints_and_likeness_equal_brute_force(spark, tmp_path):
    docs = corpus(spark, 30, 5).where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in winnow.op5_winnowing(spark, str(tmp_path)).collect()}
    printed = lambda es: " ".join(f"{(e >> 24) & (1 << 40) - 1:X}@{0xFFFFFF - (e & 0xFFFFFF):X}" for e in es)
    hashes = lambda es: {(e >> 24) & (1 << 40) - 1 for e in es}
    for i, (doc, t) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        m = len(t) // 3
        own, new, other = brute_entries(t), brute_entries(t[: len(t) - m] + after[:m]), brute_entries(after)
        like = lambda a, b: len(hashes(a) & hashes(b)) / len(hashes(a) | hashes(b)) if a or b else 1.0
        g = got[doc]
        assert (g["fingerprint"], g["edited_fingerprint"]) == (printed(own), printed(new))
        assert abs(g["near_edited"] - like(own, new)) < 1e-12 and abs(g["near_next"] - like(own, other)) < 1e-12


def test_string_kernel_equals_sets():
    r = random.Random(6)
    parts = [" ".join("".join(r.choice("abcdéñ") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 80))).encode() for _ in range(30)]
    sets = [{p[i : i + n] for n in range(1, langid.SPECTRUM + 1) for i in range(len(p) - n + 1)} for p in parts]
    kernel = langid.Spectrum(parts[:7]).kernel(parts)
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets[:7]] for a in sets]
    assert np.allclose(kernel, want)
    assert langid.segments("½ ² ① Ⅷ 12") == [] and langid.segments("1 é 2") == ["é".encode().join([b" ", b" "])]


def test_malformed_pages_take_linear_time():
    import time

    model, n = html.TreeModel.fit(html.training_pages(60)), 60_000
    for source in ("<a " * n, "<span>" * n + "x</p>" * n, "<a '>' " * n, "<p><td>" + "<span>" * n + "<h1></h1>" * n, "<div>" * n + "x" + "</div>" * n, '<a "' * n + ">", "<li>" * n, "<b><p>" * n, "<form>" * n + "t"):
        began = time.process_time()
        model.text(source)
        assert time.process_time() - began < 10, source[:20]


def test_pages_that_no_generator_wrote():
    model = html.TreeModel.fit(html.training_pages())
    wrapped = "<html><body><form action=x id=aspnet><input type=hidden value=1><div class=header><a href=/>Home</a></div><div class=content><h1>River levels fall</h1><p>The river fell by two metres over the dry summer, the agency said.</p><p>Boats can't pass the lock until the rain comes back in autumn.</p></div></form></body></html>"
    assert model.text(wrapped) == "River levels fall\n\nThe river fell by two metres over the dry summer, the agency said.\n\nBoats can't pass the lock until the rain comes back in autumn."
    blog = """<body><header><h2>My blog</h2></header><nav><a href=1>About</a> <a href=2>Archive</a></nav><main><article><h1>Bread</h1><p>Mix flour &amp; water, and wait for a whole day before baking.</p><ul><li>500 g of flour</li><li>350 g of water</li></ul>
      <form><p>Get our letter every week, free of charge.</p><input name=mail></form></article><section class="comments"><h3>3 comments</h3><div class="comment"><p>Great recipe, thanks a lot!</p></div></section></main>
      <aside class="sidebar"><h3>Popular</h3><ul><li><a href=3>Cake</a></li></ul></aside><div class="cookie-notice">We use cookies.</div><footer>&copy; 2024</footer></body>"""
    assert model.text(blog) == "Bread\n\nMix flour & water, and wait for a whole day before baking.\n\n500 g of flour\n\n350 g of water"
