"""Containment, as-of lookup, merged intervals and scopes against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import SPACES, lexical_terms, selection_limit, strip
from lodestone.operators import containment, evaluate, intervals, profiles, scopes


def holding(spark, terms, texts, size=4):
    t = spark.createDataFrame([(x,) for x in terms], "term string")
    d = spark.createDataFrame(list(texts.items()), "id long, normal string")
    return sorted((r.id, r.term) for r in containment.holding(t, d, ["id"], size=size).collect())


def plain(terms, texts):
    return sorted((i, t) for i, x in texts.items() for t in {t for t in terms if t} if t in (x or ""))


@pytest.mark.parametrize("size", [1, 3, 4])
def test_containment_equals_all_pairs(spark, size):
    draw = random.Random(size)
    word = lambda n: "".join(draw.choices("abc中😀\n.", k=n))
    texts = {i: word(draw.randrange(60)) for i in range(120)} | {900: None, 901: ""}
    terms = [word(draw.randrange(1, 9)) for _ in range(150)] + [texts[3], texts[4][:20], "", None, "abc", "abc", "zzzzzz"]
    assert holding(spark, terms, texts, size) == plain(terms, texts)


def test_containment_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(containment, "is_small", lambda *_: False)
    texts = {i: f"number {i} of many, {i * i}" for i in range(60)}
    terms = ["number 1", "many", "of", "36", "numbers", "9 of many, 81", "😀"]
    assert holding(spark, terms, texts) == plain(terms, texts)
    asked = spark.createDataFrame([("many",)], "term string")
    plan = containment.holding(asked, spark.createDataFrame(list(texts.items()), "id long, normal string"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_containment_of_nothing(spark):
    assert holding(spark, [], {1: "a"}) == holding(spark, ["", None], {1: "a"}) == holding(spark, ["a"], {}) == []
    with pytest.raises(ValueError):
        holding(spark, ["a"], {1: "a"}, 0)


def test_profiles_make_no_pairs(spark):
    rows = spark.createDataFrame([(f"d::{i}", "d", i, f"text {i} with 12.5 percent and {i}", [1.0, 0.0]) for i in range(30)], "chunk_id string, doc_id string, sequence int, clean_text string, embedding array<double>")
    asked = spark.createDataFrame([(1, "which 12.5 percent", [1.0, 0.0], None), (2, "number 7", [0.0, 1.0], "d"), (3, "text", [0.0, 1.0], "other")], "query_id long, question string, embedding array<double>, scope string")
    for found in (profiles.keyword_scores(asked, rows), profiles.exact_scores(asked, rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.query_id for r in profiles.keyword_scores(asked, rows).collect()} == {1}
    assert sorted((r.query_id, r.chunk_id) for r in profiles.exact_scores(asked, rows).collect() if r.query_id == 2) == [(2, f"d::{i}") for i in (17, 27, 7)]


def test_as_of_equals_a_plain_search(spark):
    draw = random.Random(1)
    marks = [(draw.choice("xy"), draw.randrange(50), f"m{i}") for i in range(40)] + [(None, 3, "n"), ("x", None, "n")]
    probes = [(draw.choice("xyz"), draw.randrange(-5, 60), i) for i in range(200)] + [(None, 4, 500), ("x", None, 501)]
    got = intervals.as_of(spark.createDataFrame(probes, "k string, place long, n long"), spark.createDataFrame(marks, "k string, begins int, name string"), ["k"], "place", "begins", ["name"])
    assert got.columns == ["k", "place", "n", "name"]
    for r in got.collect():
        fit = [(b, m) for k, b, m in marks if k is not None and b is not None and r.place is not None and k == r.k and b <= r.place]
        assert r.name == (max(fit)[1] if fit else None), r
    assert got.count() == len(probes)
    with pytest.raises(ValueError):
        intervals.as_of(got, got, ["k"], "place", "place", ["name"])


@pytest.mark.parametrize("touching", [False, True])
def test_merged_equals_a_plain_sweep(spark, touching):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), s, s + draw.choice([0, 1, 5, 9])) for s in (draw.randrange(200) for _ in range(90))]
    rows += [("c", 1, 9), ("c", 2, 3), ("c", 1, 9), ("c", 9, 10), ("c", 12, 13), ("d", None, 4), ("d", 4, None)]
    want = []
    for key in "abc":
        runs = []
        for _, start, stop in sorted(r for r in rows if r[0] == key):
            if runs and (start <= runs[-1][1] if touching else start < runs[-1][1]):
                runs[-1] = [runs[-1][0], max(runs[-1][1], stop), runs[-1][2] + 1]
            else:
                runs.append([start, stop, 1])
        want += [(key, *r) for r in runs]
    got = intervals.merged(spark.createDataFrame(rows, "k string, start int, stop int"), ["k"], "start", "stop", touching=touching)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_scopes(spark):
    known = spark.createDataFrame([("a", "Guide", "/a", "complete"), ("b", "Guide", "/b", "complete"), ("c", "a", "/c", "building"), ("d", None, None, "complete")], "doc_id string, name string, path string, state string")
    asked = spark.createDataFrame(list(enumerate(["a", "Guide", "/b", "c", "nothing", None, "", "uid", "/"])), "query_id long, scope string")
    got = {r.query_id: (r.doc_id, r.outcome) for r in scopes.resolve(asked, known).collect()}
    assert got == {0: ("a", "ok"), 1: (None, "ambiguous"), 2: ("b", "ok"), 3: ("c", "incomplete"), 4: (None, "unknown"), 5: (None, "all"), 6: (None, "unknown"), 7: (None, "unknown"), 8: (None, "unknown")}
    loose = {r.query_id: r.resolved for r in scopes.resolve_loosely(asked, known).collect()}
    assert loose == {0: "a", 1: "a", 2: "b", 3: "c", 4: "nothing", 5: None, 6: None, 7: "a", 8: "a"}


def test_strip_is_linear_and_strips_what_python_does(spark):
    texts = [f"{a}x{s}y{b}" for s in SPACES for a in ("", s, f"{s} ") for b in ("", s, f"\t{s}")] + ["", " ", SPACES, "x", None]
    got = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == (None if texts[r.n] is None else texts[r.n].strip()) for r in got)
    long = spark.createDataFrame([("x" + " " * 1_000_000 + "y" + "\n" * 1_000,)], "t string")
    long.select(F.length("t")).collect()
    began = time.perf_counter()
    assert long.select(F.length(strip(F.col("t")))).first()[0] == 1_000_002
    assert time.perf_counter() - began < 3


def test_limits_and_han_terms(spark):
    asked = [("分别比较原因？条件？", 6, 6), ("收入是多少", 6, 3), ("步骤和影响；以及？", 4, 4), ("", 6, 3), ("a? b? c? d? e?", 10, 6), ("原因", 2, 2)]
    rows = spark.createDataFrame(asked, "q string, budget int, want int")
    assert all(r.most == r.want for r in rows.select("want", selection_limit(F.col("q"), F.col("budget")).alias("most")).collect())
    said = [("营业收入 revenue_2024 A-1 中", ["营业", "业收", "收入", "revenue_2024", "a-1", "中"]), ("___ -- _a_ 数据", ["_a_", "数据"]), ("", [])]
    got = spark.createDataFrame([(s,) for s, _ in said], "t string").select("t", lexical_terms(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in got} == dict(said)


def test_means_of_outputs(spark):
    runs = spark.createDataFrame([(2, 10, 3), (None, None, None), (4, 20, 5)], "returned_chunks int, returned_context_characters int, returned_context_tokens int")
    assert tuple(evaluate.output_means(runs).first()) == (2.0, 10.0, 8 / 3)
    assert tuple(evaluate.output_means(runs.drop("returned_context_tokens")).first()) == (2.0, 10.0, None)
    stages = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "stage string, seconds double")
    assert {r.stage: r.median_seconds for r in evaluate.stage_medians(stages).collect()} == {"a": 2.0, "b": 5.0}
