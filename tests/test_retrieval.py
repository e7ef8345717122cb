import math

import numpy as np
import pytest

from lodestone.operators import chunking, dense, evaluate, fusion, graph, lexical, profiles, topics


def test_fusion_by_hand(spark):
    a = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "b", 1), ("q", "c", 2), ("q", "d", 3)], "query_id string, chunk_id string, rank int")
    got = fusion.rrf({"x": a, "y": b}).orderBy("fusion_rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c", "d"] and math.isclose(got[0].fusion_score, 1 / 62 + 1 / 61)
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            fusion.rrf({"x": a}, bad)
    again = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "a", 1.0)], "query_id string, chunk_id string, s double")
    assert [(r.chunk_id, r["rank"]) for r in fusion.dense_ranks(again, ["s"]).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_reranker_checks(spark):
    pool = spark.createDataFrame([("q", "a", 1, None), ("q", "b", 2, None), ("q", "c", 3, "fusion_cap")], "query_id string, chunk_id string, fusion_rank int, omission_reason string")
    scores = lambda *rows: spark.createDataFrame(rows, "query_id string, chunk_id string, rerank_score double")
    got = {r.chunk_id: (r.final_rank, r.omission_reason) for r in fusion.apply_rerank(pool, scores(("q", "b", 1.0))).collect()}
    assert got == {"a": (None, "reranker_omitted"), "b": (1, None), "c": (None, "fusion_cap")}
    for bad in ([("q", "b", float("nan"))], [("q", "b", 1.0), ("q", "b", 2.0)]):
        with pytest.raises(Exception, match="reranker"):
            fusion.apply_rerank(pool, scores(*bad)).collect()


def test_dense_ties_scopes_and_dimensions(spark):
    rows = spark.createDataFrame([(c, d, [x, 1.0]) for c, d, x in (("b", "1", 1.0), ("a", "2", 1.0), ("c", "1", 5.0))], "chunk_id string, doc_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0], None), ("r", [1.0, 0.0], "1")], "query_id string, embedding array<double>, scope string")
    got = dense.dense_topk(asked, rows, 2, scope_col="doc_id").orderBy("query_id", "vector_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in got] == [("q", "c"), ("q", "a"), ("r", "c"), ("r", "b")]
    with pytest.raises(Exception, match="dimension"):
        dense.dense_topk(spark.createDataFrame([("q", [1.0])], "query_id string, embedding array<double>"), rows, 2).collect()
    with pytest.raises(ValueError):
        dense.dense_topk(asked, rows, 0)
    assert dense.dense_topk(asked.limit(0), rows, 2).collect() == []


def test_bm25_statistics_ignore_scope(spark):
    rows = spark.createDataFrame([("a", "red apple"), ("b", "red red pear"), ("c", "blue")], "chunk_id string, clean_text string")
    asked = spark.createDataFrame([("q", "apple APPLE", None), ("r", "red", "B")], "query_id string, question string, scope string")
    seen = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "chunk_id string, scope string")
    index = lexical.postings(rows)
    got = {(r.query_id, r.chunk_id): r.bm25 for r in lexical.bm25_topk(asked, index, lexical.statistics(rows, index), visible=seen).collect()}
    norm = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got.keys() == {("q", "a"), ("r", "b")}
    assert math.isclose(got["q", "a"], -math.log(2.5 / 1.5) * norm(1, 2)) and math.isclose(got["r", "b"], -1e-6 * norm(2, 3))


def test_asked_topk_without_an_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SCORES_AT_ONCE", 4)  # two chunks at once
    rows = spark.createDataFrame([(f"{i:02d}", f"{i % 3}", " ".join(("red apple", "red red -- pear", "blue _", "增长 red")[i % 4 : i % 4 + 2 if i > 8 else 4])) for i in range(11)] + [("zz", "9", None)], "chunk_id string, doc_id string, clean_text string")
    rows = rows.unionByName(spark.createDataFrame([("a", "0", "red apple"), ("b", "1", "red red pear"), ("c", "2", "blue 增长"), ("d", "1", "pear")], rows.schema))
    asked = spark.createDataFrame([("q", "apple APPLE red", None), ("r", "red pear", "1"), ("s", "nowhere", None), ("t", None, None), ("u", "增长", "2")], "query_id string, question string, scope string")
    seen, index = rows.select("chunk_id", rows.doc_id.alias("scope")), lexical.postings(rows)
    want = lexical.bm25_topk(asked, index, lexical.statistics(rows, index), 3, visible=seen).orderBy("query_id", "lexical_rank").collect()
    for at_once in (2, 100):
        monkeypatch.setattr(lexical, "QUESTIONS_AT_ONCE", at_once)
        got = lexical.asked_topk(asked, rows, 3, scope_col="doc_id").orderBy("query_id", "lexical_rank")
        assert [(r.query_id, r.chunk_id, r.lexical_rank) for r in got.collect()] == [(r.query_id, r.chunk_id, r.lexical_rank) for r in want]
        assert all(math.isclose(a.bm25, b.bm25) for a, b in zip(got.collect(), want, strict=True))
    assert {r.query_id for r in want} == {"q", "r", "u"} and lexical.asked_topk(asked.limit(0), rows).collect() == []
    plan = lexical.asked_topk(asked, rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no pairs of questions and chunks


def test_concept_hits_of_many_questions_equal_a_plain_walk(spark):
    words = ["alpha", "alphabet", "bet", "gamma", "gam", "delta", "el", "x-ray", "ra"]
    rows = [(str(i), f"{words[i % 9]} {words[i * 5 % 9]} {words[i * 7 % 9]} {words[(i + 1) % 9]}") for i in range(12)]
    own = graph.chunk_concepts(spark.createDataFrame(rows, "chunk_id string, clean_text string"))
    edges = graph.concept_edges(own).filter("weight > 2")
    asked = spark.createDataFrame([(f"q{i}", ("bet", "gamma ray", "a delta", "nothing", "alphabets")[i % 5]) for i in range(130)], "query_id string, question string")
    terms, links, held = {}, [(r.source, r.target) for r in edges.collect()], [(r.chunk_id, r.concept) for r in own.collect()]
    for r in graph.question_terms(asked).collect():
        terms.setdefault(r.query_id, set()).add(r.term)
    touch = lambda some, known: {c for c in known if any(t in c or c in t for t in some)}
    want = {}
    for q, some in terms.items():
        hit = touch(some, {a for a, _ in links})
        found = touch(some | hit | {b for a, b in links if a in hit}, {c for _, c in held})
        for chunk, c in held:
            if c in found:
                want[q, chunk] = want.get((q, chunk), 0) + 1
    assert {(r.query_id, r.chunk_id): r.hits for r in graph.concept_hits(asked, own, edges).collect()} == want and len(terms) > graph.BITS


def test_concepts_are_counted_without_a_shuffle(spark, monkeypatch):
    rows = spark.createDataFrame([("1", "beta alpha beta gamma alpha delta"), ("2", None), ("3", "12 !")], "chunk_id string, clean_text string")
    found = graph.chunk_concepts(rows, limit=3)
    assert [tuple(r) for r in found.orderBy("place").collect()] == [("1", "beta", 2, 1), ("1", "alpha", 2, 2), ("1", "gamma", 1, 3)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_documents_of_topics_cross_batches(spark, monkeypatch):
    rows = [(f"d{i // 7}", i % 7, f"c{i}", [1.0, 0.0] if i % 2 else [0.0, 1.0], "t", ["x"]) for i in range(40)]
    given = spark.createDataFrame(rows[::-1], "doc_id string, sequence int, chunk_id string, embedding array<double>, chapter string, concepts array<string>")
    monkeypatch.setattr(topics, "ROWS_AT_ONCE", 3)
    got = {r.topic_id: r.chunk_ids for r in topics.build_topics(given).collect()}
    assert len(got) == 12 and got["d0::topic_0000"] == ["c0", "c2", "c4", "c6"] and got["d1::topic_0001"] == ["c8", "c10", "c12"]


def test_graph(spark):
    rows = spark.createDataFrame([("1", "alpha beta alpha"), ("2", "alphabet gamma"), ("3", "delta")], "chunk_id string, clean_text string")
    own = graph.chunk_concepts(rows)
    assert [(r.concept, r.n) for r in own.filter("chunk_id = '1'").orderBy("place").collect()] == [("alpha", 2), ("beta", 1)]
    edges = graph.concept_edges(own)
    assert {tuple(r) for r in edges.collect()} == {("alpha", "beta", 1), ("beta", "alpha", 1), ("alphabet", "gamma", 1), ("gamma", "alphabet", 1)}
    asked = spark.createDataFrame([("q", "alpha")], "query_id string, question string")
    hits = {r.chunk_id: r.hits for r in graph.concept_hits(asked, own, edges).collect()}
    assert hits == {"1": 2, "2": 2}
    assert graph.adjacency(edges).count() == 4


def test_bridges_use_a_snapshot(spark):
    chunks = spark.createDataFrame([(f"c{n}", "d", n) for n in range(5)], "chunk_id string, doc_id string, sequence int")
    scores = spark.createDataFrame([("q", "c1", 1.0), ("q", "c2", 0.1)], "query_id string, chunk_id string, score double")
    got = {r.chunk_id: round(r.score, 4) for r in profiles.bridge(scores, chunks, 1).collect()}
    assert got == {"c0": 0.82, "c1": 1.0, "c2": 0.82, "c3": 0.082}
    with pytest.raises(ValueError):
        profiles.retrieve("other", chunks, chunks)


def test_topics():
    assert topics.cluster([np.array(v) for v in ([1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0])]) == [0, 0, 1, -1]


def test_metrics_by_hand(spark):
    rank = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("q", "a", 3), ("q", "c", 4)], "query_id string, doc_id string, rank int")
    grades = spark.createDataFrame([("q", "a", 3), ("q", "z", 1), ("q", "b", 0), ("r", "a", 1)], "query_id string, doc_id string, grade int")
    got = {r.query_id: r for r in evaluate.ranking_metrics(rank, grades, 5).collect()}
    assert got["q"].recall == 0.5 and got["q"].mrr == 0.5 and math.isclose(got["q"].ndcg, (7 / math.log2(3)) / (7 + 1 / math.log2(3)))
    assert got["r"].recall == got["r"].ndcg == 0
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    runs = spark.createDataFrame([("q", 1.0, False), ("r", 3.0, True)], "query_id string, seconds double, failed boolean")
    s = evaluate.summarize(queries, runs, rank, grades).first()
    assert s.p50_seconds == 2.0 and s.recall_at_5 == 0.25 and s.failed_queries == 1 and s.successful_p50_seconds == 1.0 and s.serial_successful_queries_per_second == 0.25


def test_coverage_denominators(spark):
    schema = "query_id string, document_ids array<string>, relevant array<string>, core_ids array<string>, supplement_ids array<string>, explicit_ids array<string>, target_ids array<string>, exhaustive boolean"
    rows = spark.createDataFrame([("q", ["x", "a"], ["a"], ["c"], ["t", "u"], ["t", "u"], ["t", "v"], True), ("r", [], [], ["c"], ["n"], [], ["n"], False)], schema)
    got = {r.metric: r for r in evaluate.aggregate_coverage(evaluate.coverage(rows)).collect()}
    assert (got["source_mrr"].value, got["source_mrr"].denominator) == (0.5, 1)
    assert got["reference_coverage"].value == 0.75 and got["false_reference_expansion"].value == 0.5
    assert evaluate.aggregate_coverage(evaluate.coverage(rows.filter("query_id = 'r'"))).filter("metric = 'false_reference_expansion'").first().status == "unavailable"


def test_ranks_close_up_behind_a_repeated_id(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3)], "query_id long, chunk_id string, rank int")
    got = {r.chunk_id: r.x_rank for r in fusion.rrf({"x": rows}).collect()}
    assert got == {"a": 1, "b": 2}


def test_comparison_chunks_are_named_by_sorted_position(spark):
    docs = spark.createDataFrame([(f"n{i:03d}", "x" * (5 + i % 3)) for i in range(50)], "doc_id string, text string").repartition(7)
    got = sorted((r.doc_id, r.sequence, r.chunk_id) for r in chunking.comparison_chunks(docs, size=6).collect())
    assert got == [(f"n{i:03d}", c, f"d{i}:c{c}") for i in range(50) for c in range(1 + (i % 3 == 2))]


def test_dense_keeps_the_best_of_all_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        values = [(7 * i) % 10 for i in range(40)]  # every score four times, spread over the batches
        rows = spark.createDataFrame([(i, [float(v), 0.0]) for i, v in enumerate(values)], "chunk_id long, embedding array<double>").coalesce(2)
        asked = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [-1.0, 0.0])], "query_id string, embedding array<double>")
        for k in (1, 6, 40, 50):
            got = dense.dense_topk(asked, rows, k, id_col="chunk_id").orderBy("query_id", "vector_rank").collect()
            want = [("q", i) for i in sorted(range(40), key=lambda i: (-values[i], i))[:k]] + [("r", i) for i in sorted(range(40), key=lambda i: (values[i], i))[:k]]
            assert [(r.query_id, r.chunk_id) for r in got] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
