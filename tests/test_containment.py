"""Few terms are looked up where texts are read, all at once."""

import random

import pytest

from lodestone.operators import containment


def test_few_terms_are_looked_up_where_texts_are_read(spark):
    terms = spark.createDataFrame([("a passage of many words that a text may hold",), ("b",), ("中文",), (None,)], "term string")
    texts = spark.createDataFrame([(1, "so a passage of many words that a text may hold, b"), (2, "x中文"), (3, None)], "id int, normal string")
    found = containment.holding(terms, texts, ["id"], size=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "regexp" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "a passage of many words that a text may hold"), (1, "b"), (2, "中文")]


@pytest.mark.parametrize("at_once", [7, 1 << 19])
def test_the_matcher_equals_all_pairs(monkeypatch, at_once):
    monkeypatch.setattr(containment, "PLACES_AT_ONCE", at_once)
    draw = random.Random(at_once)
    word = lambda n: "".join(draw.choices("abc中😀\n.\ud800", k=n))
    texts = [word(draw.randrange(60)) for _ in range(80)] + [None, ""]
    terms = sorted({word(draw.randrange(1, 9)) for _ in range(80)} | {t[2:30] for t in texts[:9] if len(t) > 2})
    for size in (1, 3, 4, 16):
        row, term = containment.Matcher(terms, texts, size)(texts)
        assert list(zip(row.tolist(), term.tolist(), strict=True)) == [(i, j) for i, t in enumerate(texts) for j, x in enumerate(terms) if x in (t or "")]
