"""Fill-in-the-middle against regular expressions over code points."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm.fill_in_middle import boundaries, code_points, fill_in_middle, restored


def plain(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:i], units[i:j], units[j:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if d % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def random_texts(n):
    draw = random.Random(7)
    parts = ["a", "b ", "\n", "\n\n", "\r\n", "é", "中文", "😀", " ", "<", "P>", "<P", "<S", "<M", ">", "\x0b", "word "]
    return ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(n)]


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 10), (0, 50)])
def test_equals_the_plain_version(spark, rate, spm):
    texts = [*random_texts(300), None, "", "\n", "x", "a<P>b", "<S>", "no marker <M", "a\n" * 50_000 + "tail", "z" * 3_000_000]
    rows = list(enumerate(texts)) + [(5, texts[5]), (None, "no id\nhere\n"), (2**62, "large\nid")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fill_in_middle(docs, rate=rate, spm_rate=spm).withColumn("again", restored()).collect()
    key = lambda x: (x[0] is None, x[0] or 0, str(x[1:]))
    want = sorted(((i, *plain(i, t, rate, spm), t or "") for i, t in rows), key=key)
    assert sorted(map(tuple, got), key=key) == want


def test_word_boundaries():
    for text in random_texts(200):
        runs = re.findall(r"[ \t-\r]+|[^ \t-\r]+", text)
        ends = boundaries(code_points(text), "words").tolist()
        assert [text[a:b] for a, b in zip(ends, ends[1:], strict=False)] == runs


def test_empty_table_clashing_columns_and_unknown_units(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n string, output string, form int")
    assert fill_in_middle(empty).collect() == []
    one = spark.createDataFrame([("k", "a\nb", "x", "y", 1)], "doc_id string, text string, n string, output string, form int")
    assert [tuple(r) for r in fill_in_middle(one).collect()] == [("k", *plain("k", "a\nb"))]
    assert fill_in_middle(one.withColumnRenamed("doc_id", "ID"), id_col="ID").select(F.col("ID")).first()[0] == "k"
    with pytest.raises(ValueError, match="units"):
        fill_in_middle(one, units="verses")
