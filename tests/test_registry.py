import os
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrill.operators import annotation, contracts, quality, registry, retrieval, sampling
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert_same(registry.queries()[name](spark, SF), registry.oracle_sql()[name], con)


def test_greedy_sample_keeps_its_invariants(spark):
    rows = registry.queries()["sample_greedy"](spark, SF).collect()
    assert len(rows) == 6 * 5 and len({r["id"] for r in rows}) == 30
    assert {r["place"] for r in rows} == {1, 2, 3, 4, 5}
    t = registry.Tables(spark, SF)
    linked = {r["id"]: r for r in t.linked.collect()}
    for column in ("caption_caption", "image_image_path"):
        assert len({linked[r["id"]][column] for r in rows}) == 30


def test_greedy_sample_goes_on_beyond_its_pool(spark):
    rows = spark.createDataFrame([(i, "a" if i < 400 else "b", "same" if i % 400 < 390 else f"c{i}") for i in range(800)], "id long, g string, c string")
    got = sampling.greedy(rows, "g", ["a", "b"], [["c"]], 5, 11, "id", pool=2).collect()
    assert sorted((r["g"], r["place"]) for r in got) == [(g, p) for g in "ab" for p in range(1, 6)]
    all_, seen, want = sampling.per_group(rows, ["g"], "id", 400, 11).orderBy("g", "draw").collect(), set(), defaultdict(list)
    for r in all_:
        if len(want[r["g"]]) < 5 and r["c"] not in seen:
            want[r["g"]].append(r["id"])
            seen.add(r["c"])
    assert [r["id"] for r in sorted(got, key=lambda r: (r["g"], r["place"]))] == want["a"] + want["b"]
    with pytest.raises(ValueError):
        sampling.greedy(rows, "g", ["a", "b"], [["c"]], 12, 11, "id", pool=2)


def test_entry_imports_without_the_optional_parts(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert e.entry(spark).count() == 1


def _plain(q, c, k):
    """(qid, cid, similarity, rank) by comparing all with all, sums as folds."""
    out = []
    for qid, x in q:
        scored = sorted((-reduce(lambda s, ab: s + float(ab[0]) * float(ab[1]), zip(x, y, strict=True), 0.0), cid) for cid, y in c)[:k]
        out += [(qid, cid, -s, i) for i, (s, cid) in enumerate(scored, 1)]
    return sorted(out)


def _vectors(spark, rows, key):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{key} long, vec array<float>")


@pytest.mark.parametrize("block", [8, 33, 1024])
def test_search_equals_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 9)) * rng.choice([1e-6, 1, 1e4], 300)[:, None]).astype(np.float32)
    v[40:90] = v[7]  # more copies than k, and near copies
    v[90:110] = v[7] * np.float32(1 + 2**-22)
    v[110:120] = 0
    rows = [(int(i), x) for i, x in zip(rng.permutation(1000)[:300], v, strict=True)]
    asked = rows[:60] + [(5000 + i, x) for i, x in rows[200:230]]
    got = retrieval.topk_inner_product(_vectors(spark, asked, "qid"), _vectors(spark, rows, "cid"), 12, block=block).collect()
    assert sorted(tuple(r) for r in got) == _plain(asked, rows, 12)


def test_search_of_long_and_infinite_vectors_passes_nothing_over(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4) * s]) for i, s in enumerate([1e25, 1, 1e-25, 1e30] * 50)]
    rows[9] = (9, [float("inf"), 0.5, 0.5, 0.5])
    make = lambda key: spark.createDataFrame(rows, f"{key} long, vec array<double>")
    got = retrieval.topk_inner_product(make("qid"), make("cid"), 7, block=16).collect()
    assert sorted(tuple(r) for r in got if r["qid"] != 9) == [r for r in _plain(rows, rows, 7) if r[0] != 9]


def test_search_keeps_what_ids_share_and_names_that_are_text(spark):
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 1.0]), ("y", [1.0, 1.0])], "qid string, vec array<double>")
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 3.0])], "cid string, vec array<double>")
    got = retrieval.topk_inner_product(q, c, 2).orderBy("qid", "raw_rank").collect()
    assert [tuple(r) for r in got] == [("x", "c", 3.0, 1), ("x", "a", 1.0, 2), ("y", "c", 3.0, 1), ("y", "a", 1.0, 2)]
    assert retrieval.topk_inner_product(q, c.limit(0), 2).count() == 0 == retrieval.topk_inner_product(q.limit(0), c, 2).count()
    with pytest.raises(Exception, match="null"):
        retrieval.topk_inner_product(q, spark.createDataFrame([("a", None)], "cid string, vec array<double>"), 2).collect()


def test_only_the_best_leave_a_search_task_whatever_the_blocks(spark):
    rows = spark.range(3_000).select(F.col("id").alias("qid"), F.array(*[F.rand(i) for i in range(4)]).alias("vec"))
    found = retrieval.topk_inner_product(rows, rows.withColumnRenamed("qid", "cid"), 3, block=16)
    assert "MapInArrow" in found._jdf.queryExecution().sparkPlan().toString().splitlines()[0]
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    seen = found.groupBy("qid").agg(F.count("*").alias("n")).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(seen) == (3_000, 3, 3)


def test_corpus_is_sent_to_fewer_parts_if_fewer_are_kept(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES", 100)
    rows = spark.range(3_000).select(F.col("id").alias("qid"), F.array(*[F.rand(i) for i in range(4)]).alias("vec"))
    few, many = (retrieval.topk_inner_product(rows, rows.withColumnRenamed("qid", "cid"), k, block=16) for k in (3, 52))
    cores = spark.sparkContext.defaultParallelism
    assert few.rdd.getNumPartitions() == cores * -(-3_000 // (1_733 * cores)) < many.rdd.getNumPartitions() == cores * -(-3_000 // (100 * cores))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.where("raw_rank <= 3").collect()))


def test_score_summary_keeps_only_the_ranks_it_reads(spark, monkeypatch):
    kept, search = [], retrieval.topk_inner_product
    monkeypatch.setattr(retrieval, "topk_inner_product", lambda q, c, k, **named: kept.append(k) or search(q, c, k, **named))
    got = registry.queries()["score_summary"](spark, SF).collect()
    assert kept == [10]
    assert got == registry.rounded(retrieval.score_summary(registry.Tables(spark, SF).ranked())).collect()


@pytest.mark.parametrize("name", ["rank_contract", "rank_order_contract", "filter_diagnostics"])
def test_ranks_are_searched_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_rank_reports_of_no_and_of_excluded_rows(spark):
    rows = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (1, 7, 0.7, 3), (2, 5, 0.9, 1), (3, 5, 0.4, 1), (3, 5, 0.5, 1)], "qid long, cid long, similarity double, raw_rank int")
    got = retrieval.filter_diagnostics(rows, F.when(F.col("cid") != 7, (F.col("cid") == 5) & (F.col("qid") < 3)), 2).first()
    assert tuple(got) == (2, 2, 2, 2, 2, 1, 1)
    assert tuple(retrieval.rank_contract(rows, 3).drop("score_rises").first()) == (1, 0, 0, 2, 1, 1)  # the order of equal ranks is open
    assert tuple(retrieval.rank_contract(rows.limit(0), 3).first()) == (0,) * 7


def test_similarity_by_label_of_odd_scores(spark):
    rng = np.random.default_rng(5)
    groups = {"one": [0.25], "two": [0.25, -1e9], "none": [None, None], "some": [None, 3.0, 1.0, 2.0], "far": [1e6 + x for x in rng.normal(size=501) * 1e-3], "same": [0.5] * 40, "wide": list(rng.normal(size=1000) * 1e17), "nan": [1.0, float("nan"), float("nan")], "inf": [float("-inf"), 1.0, 2.0, 3.0]}
    rows = spark.createDataFrame([("a", g, None if x is None else float(x)) for g, v in groups.items() for x in v], "channel string, event_label string, similarity double")
    got = {r["event_label"]: r for r in annotation.similarity_by_label(rows, ["channel"]).collect()}
    want = rows.groupBy("event_label").agg(F.count("*").alias("n_rows"), F.avg("similarity").alias("mean_sim"), F.median("similarity").alias("median_sim"), F.stddev_samp("similarity").alias("std_sim"), F.min("similarity").alias("min_sim"), F.max("similarity").alias("max_sim")).collect()
    assert len(want) == len(got) == len(groups)
    for r in want:
        for c in r.asDict():
            assert got[r["event_label"]][c] == (r[c] if r[c] is None or isinstance(r[c], str) else pytest.approx(r[c], rel=1e-7, nan_ok=True)), (r["event_label"], c)


def test_no_task_of_similarity_by_label_holds_a_map_of_scores(spark):
    plan = registry.queries()["similarity_by_label"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile" not in plan


@pytest.mark.parametrize("name", ["similarity_by_label", "deeper_labels", "label_reuse", "contract_coverage_of_ranks", "first_rank_stats"])
def test_each_channel_is_searched_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_deeper_labels_counts_repeats_and_null_keys(spark):
    new = spark.createDataFrame([(1, 1, 6, "SAME", True), (1, 1, 7, "SAME", True), (1, 2, 5, "MAYBE", False), (None, 3, 9, None, None), (None, 3, 9, "RELATED", True)], "qid long, cid long, rank int, event_label string, is_nontrivial_same boolean")
    old = spark.createDataFrame([(1, 1), (1, 1), (None, 3), (8, 8)], "qid long, cid long")
    got = lambda a, b: dict(tuple(r) for r in contracts.deeper_labels(a, b, ["qid", "cid"]).collect())
    assert got(new, old) == {"label": 2, "rank": 1, "flag": 1, "repeated:qid,cid": 2, "already_labelled": 2}
    assert set(got(new.limit(0), old).values()) == {0}


def test_labels_are_reused_within_one_table(spark):
    rows = spark.createDataFrame([("a", 1, 2, 1, "SAME"), ("b", 1, 2, 9, "OLD"), ("a", 1, 3, 6, "SAME"), ("a", None, 4, 1, "SAME"), ("b", None, 4, 1, "OLD")], "channel string, qid long, cid long, rank int, event_label string")
    want = quality.label_reuse(rows.drop("event_label"), rows.where("channel = 'a' AND rank <= 5"), ["qid", "cid"], ["event_label"])
    got = quality.label_reuse(rows, F.expr("channel = 'a' AND rank <= 5"), ["qid", "cid"], ["event_label"])
    assert sorted(map(str, got.select(*sorted(got.columns)).collect())) == sorted(map(str, want.select(*sorted(got.columns)).collect()))


def test_coverage_counts_each_violation(spark):
    rows = [("a", 1, 3, 0.3), ("a", 5, 4, 0.2), ("b", 1, None, None), ("b", 5, 9, 1.5), ("union", 1, 2, 0.2), ("union", 5, 20, 0.9), ("union", 9, 20, 0.1)]
    table = spark.createDataFrame(rows, "scope string, depth int, n_covered long, rate double")
    assert [tuple(r) for r in contracts.coverage(table).collect()] == [("rate", 1), ("union_low", 1), ("union_high", 1), ("falls", 3)]
    assert {r["n"] for r in contracts.coverage(table.limit(0)).collect()} == {0}


@pytest.mark.parametrize("dim", [1, 2, 9, 64])
@pytest.mark.parametrize("n", [1, 2, 3, 500])
def test_scores_are_folds_whatever_the_number_of_pairs(n, dim):
    rng = np.random.default_rng(6)
    a, b = (rng.normal(size=(n, dim)).astype(np.float32) for _ in "ab")
    want = [reduce(lambda s, xy: s + float(xy[0]) * float(xy[1]), zip(x, y, strict=True), 0.0) for x, y in zip(a, b, strict=True)]
    assert retrieval._folded(a, b).tolist() == want


def test_masks_of_an_empty_table_are_counted_as_in_sql(spark, tmp_path):
    spark.read.parquet(f"{SF}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["exclusion_masks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("image_to_image", 0), ("image_to_text", 0), ("text_to_text", 0)]


def test_duplicate_pairs_count_queries_without_expanding_rows(spark):
    assert "Expand" not in registry.queries()["dup_pair_diag"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1, 5, 0), (1, 6, 1), (2, 5, 0), (2, 7, 0), (2, 8, 1), (None, 5, 0), (None, 6, 0), (3, 9, None)], "qid long, cid long, g long")
    assert tuple(retrieval.duplicate_pairs(rows, F.col("g")).first()) == (7, 2, 1)
    assert tuple(retrieval.duplicate_pairs(rows.limit(0), F.col("g")).first()) == (0, 0, 0)


def test_coverage_counts_queries_without_expanding_rows(spark):
    assert "Expand" not in registry.queries()["coverage_by_depth"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    first = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "a", None), (2, "a", 2), (None, "a", 1)], "qid long, channel string, first_rank int")
    got = {(r["scope"], r["depth"]): (r["n_queries"], r["n_covered"], r["rate"]) for r in annotation.coverage_by_depth(first, [1, 2]).collect()}
    assert got == {("a", 1): (2, 0, 0.0), ("a", 2): (2, 1, 0.5), ("b", 1): (1, 1, 1.0), ("b", 2): (1, 1, 1.0), ("union", 1): (2, 1, 0.5), ("union", 2): (2, 2, 1.0)}


@pytest.mark.parametrize("name", ["candidate_union", "workload"])
def test_unions_of_candidates_read_no_labels(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Join Inner" not in plan


def _plan(spark, name):
    """The physical plan without broadcasts, as for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    ("name", "most"),
    [("event_rates", 7), ("event_rates_subsets", 7), ("sensitivity", 8), ("exclusion_accounting", 7), ("visual_repeats", 6), ("first_rank", 6), ("reviewed_prefix", 6), ("coverage_by_depth", 7), ("rank_rates", 8)],
)
def test_ranked_rows_are_dealt_out_by_candidate_and_claim_only(spark, name, most):
    plan = _plan(spark, name)
    assert plan.count("MapInArrow") == 2
    assert plan.count("Exchange hashpartitioning") <= most  # two of each search's corpus, two labels, rows by candidate and by claim; reports
