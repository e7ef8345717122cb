import os

import pytest
from pyspark.sql import functions as F

from lodestone.llm import queries
from lodestone.llm.preferences import format_pairs, neighbours, other_replies


def rows(spark, given):
    df = spark.createDataFrame([(*g, 0) for g in given], "conv_id long, turn long, role string, text string, n int")
    return {r.pair_id: r.asDict() for r in neighbours(df).collect()}


def test_common_prefix_is_rendered_once(spark):
    got = rows(spark, [(2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "ok"), (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (3, 2, "user", "why"), (3, 3, "assistant", "so")])[1]
    assert got["prompt"] == "<|user|>\nhi<|end|>\n" and got["n_common"] == 1
    assert got["chosen"] == "<|assistant|>\nyes<|end|>\n<|user|>\nok<|end|>\n" and got["chosen_mask"] == "10"
    assert got["rejected_mask"] == "101" and (got["chosen_id"], got["rejected_id"]) == (2, 3)


def test_identical_and_missing_sides(spark):
    got = rows(spark, [(0, 0, "user", "a"), (1, 0, "user", "a"), (4, 0, "user", "b"), (7, 0, None, None), (7, 0, None, None)])
    assert (got[0]["n_common"], got[0]["chosen"], got[0]["rejected"]) == (1, "", "")
    assert (got[2]["prompt"], got[2]["rejected_id"], got[2]["rejected"]) == ("", None, "")
    assert got[3]["rejected"] == "<||>\n<|end|>\n" * 2 and got[3]["chosen_id"] is None


def test_one_side_prefix_of_the_other_and_nulls(spark):
    got = rows(spark, [(0, 0, "user", "a"), (0, 1, "assistant", "x"), (1, 0, "user", "a"), (None, 0, "user", "z")])
    assert set(got) == {0} and got[0]["n_common"] == 1 and got[0]["rejected"] == "" and got[0]["chosen_mask"] == "1"


def test_other_pairings_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (9, 0, "user", "b")], "conv_id long, turn long, role string, text string")
    got = format_pairs(df, F.lit("p"), F.col("conv_id") == 9).collect()
    assert [(r.pair_id, r.chosen_id, r.rejected_id) for r in got] == [("p", 1, 9)]
    assert neighbours(df.limit(0)).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = neighbours(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pairs_fork_at_the_last_reply(spark):
    given = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d"), (2, 0, "user", "x"), (2, 1, "assistant", "y"), (2, 1, "assistant", "y"), (3, 0, "user", "q"), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*g, 0) for g in given], "conv_id long, turn long, role string, text string, n int")
    got = {r.pair_id: r for r in other_replies(df).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1].n_common == 3 and got[1].prompt.count("<|end|>") == 3
    assert (got[1].chosen, got[1].rejected) == ("<|assistant|>\nd<|end|>\n", "<|assistant|>\ny<|end|>\n")
    assert got[2].n_common == 1 and got[2].rejected == "<|assistant|>\n<|end|>\n" * 2 and got[2].rejected_mask == "11"
    assert got[3].n_common == 1 and got[3].chosen == got[3].rejected == ""


def test_most_prompts_of_the_query_are_not_empty(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("the tables are not here")
    got = queries.op5_preferences(spark, "/root/testdata/sf0.01")
    assert got.filter("prompt <> ''").count() > 0.9 * got.count() > 0


def test_ids_of_other_types(spark):
    turns = [("a", 1, "user", "q"), ("a", 2, "assistant", "r"), ("7", 1, "assistant", "x"), ("8", 1, "assistant", "y")]
    got = {r.pair_id: (r.chosen, r.rejected) for r in other_replies(spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")).collect()}
    shown = lambda t: f"<|assistant|>\n{t}<|end|>\n"
    assert got == {"a": (shown("r"), shown("")), "7": (shown("x"), shown("y")), "8": (shown("y"), shown(""))}
    least = spark.createDataFrame([(-(2**63), 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    assert other_replies(least).first().rejected == shown("")
