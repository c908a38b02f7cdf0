import random

import corpus_pipeline
from evidrill.llm import bpe


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice(["ka", "lo", "mi", "su", "te"]) for _ in range(3))
    rows, labels = [], []
    passage = " ".join(word() for _ in range(60))
    for i in range(300):
        w = [word() for _ in range(80)]
        toxic = int(i % 5 == 1)
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(["vilexo", "grumpf"]))
        rows.append((i, " ".join(w) + (" " + passage if i % 50 == 0 else ""), "xx", "s", 0))
        labels.append((i, 1, toxic))
    rows += [(400, rows[0][1], "xx", "s", 0), (401, "123 456", "xx", "s", 0), (402, None, None, None, None)]
    other = lambda: "".join(r.choice(["\u0434\u0430", "\u043d\u043e", "\u043c\u0438"]) for _ in range(3))
    for i in range(500, 560):  # another language, and a text with as much of it
        rows.append((i, " ".join(other() for _ in range(80)), "yy", "s", 0))
    halves = [next(w for w in iter(lambda: " ".join(f() for _ in range(200)), None)) for f in (word, other)]
    rows.append((403, halves[0] + " " + halves[1][: len(halves[0]) // 2], None, "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), ["doc_id", "text", "lang", "source", "n_chars"]
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        left.append({x["doc_id"] for x in docs.select("doc_id").collect()})
    clean = {i for i in range(300) if i % 5 != 1} | set(range(500, 560))
    assert left[0] - {403} == clean | {400, 401, 402} and left[1] - {403} == clean | {400} and left[2] - {403} == left[3] - {403} == clean
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert passage in text[0] and all(passage not in text[i] for i in (50, 100, 150))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    e = bpe.TreeEncoder(bpe.vocabulary(bpe.BYTE_VOCAB))
    assert sum(x["length"] for x in packed) == sum(len(e.encode(t)) + 1 for t in text.values())


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __doc int, __th string, terms string, score string, __spans string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = [(i, f"ka lo mi {i} su te ka su mi lo ka", "xx", "s", 0, i, "a", "b", "c", "d") for i in range(30)]
    docs = spark.createDataFrame(rows + [(None, rows[0][1], "xx", "s", 0, 1, "a", "b", "c", "d"), rows[0]], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "none"))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    assert docs.where("doc_id is null").count() == 1 and docs.where("doc_id = 0").count() == 1
    assert all((x["__doc"], x["score"]) == (x["doc_id"], "c") for x in docs.where("doc_id is not null").collect())
