import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embedding, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [("收入：1,234.50 万元；同比 增长 8%。", "收入1234.50万元同比增长8%。"), ("A.B 1.2.3. x", "ab1.2.3x"), ("１，２３４", "1234"), ("1,2345", "12345"), (None, ""), ("3,456,789 a", "3456789a")],
)
def test_normal_form(spark, given, want):
    assert one(spark, given, text.normalize_evidence) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("营业收入 Revenue_1 --", ["营业", "业收", "收入", "revenue_1"]), ("中 A-1 中国中国", ["中", "a-1", "中国", "国中", "中国"]), ("ＡＢ１ 𠀀𠀁", ["ab1", "𠀀𠀁"]), ("", []), (None, [])],
)
def test_lexical_terms(spark, given, want):
    assert one(spark, given, text.lexical_terms) == want


def test_encodings(spark):
    assert one(spark, "收 a_1", text.index_text) == "t" + "收".encode().hex() + " t" + b"a_1".hex()
    assert one(spark, "a b a", text.match_literals) == '"t61" OR "t62"'
    assert one(spark, '" OR *', text.match_literals) == '"t6f72"'


def test_query_terms_cross_spaces_and_punctuation(spark):
    assert one(spark, "hello world 收，入增", text.query_terms) == ["helloworld", "收入", "入增", "hello", "world"]
    assert one(spark, "10.5% of 1,234 and 7", text.numeric_tokens) == ["10.5%", "1234", "7"]


def test_concepts(spark):
    assert one(spark, "收入 公司 收入 profit a b2 利润", text.extract_concepts) == ["收入", "profit", "b2", "利润"]
    assert [one(spark, v, text.valid_concept) for v in ("公司", "a", "12_", "ok", "x" * 25, None)] == [False, False, False, True, False, False]


def test_chapter_id_and_limit(spark):
    assert one(spark, "## 第一章：\nx", text.chapter_guess) == "第一章"
    assert one(spark, "x" * 31, text.chapter_guess) == one(spark, "", text.chapter_guess) == text.NO_CHAPTER
    assert one(spark, "/a/b/My file (1).txt", text.document_id).startswith("My_file_1_")
    assert one(spark, "分别比较？条件？", lambda q: text.selection_limit(q, 6)) == 6
    assert one(spark, "收入", lambda q: text.selection_limit(q, 2)) == 2


def test_embedding(spark):
    got = np.array(one(spark, "Ab c", embedding.deterministic()))
    want = np.zeros(256)
    for i, c in enumerate("abc"):
        want[(ord(c) + 17 * i) % 256] += 1
    for a, b in ("ab", "bc"):
        want[(31 * ord(a) + ord(b)) % 256] += 0.5
    assert np.allclose(got, want / np.linalg.norm(want))
    assert not any(one(spark, " ", embedding.deterministic()))
    with pytest.raises(ValueError):
        embedding.deterministic(4)
    with pytest.raises(ValueError):
        embedding.backend("unknown")


def test_flags():
    assert [text.as_bool(v) for v in (None, "YES", " on ", "0")] == [False, True, True, False]


def test_han_texts_need_no_python(spark):
    rows = spark.createDataFrame([("营业 revenue 增长",), ("ｆｕｌｌ",)], "t string")
    import lodestone.functions.text as text
    from pyspark.sql import functions as F

    assert [r.s for r in rows.select(F.col("t").rlike(text.STABLE).alias("s")).collect()] == [True, False]
    assert all(__import__("unicodedata").normalize("NFKC", chr(c)) == chr(c) for c in (*range(0x3400, 0x4DC0), *range(0x4E00, 0xA000)))
