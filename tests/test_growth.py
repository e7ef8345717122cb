"""Steps whose work must not grow faster than their tables: what is shuffled, and how often tables are read."""

import re
import sys
import unicodedata
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions.text import candidates_of, concept_candidates, has_digits, lexical_terms, numeric_tokens, terms_of
from lodestone.operators import graph, lexical, profiles
from lodestone.sources import index

TEXTS = ["Apples and pears_ -- _x9 ___ a-b", "营业收入 grew; 数 KÅ ﬁne İstanbul 公司", "", None, "apples apples 营业收入增长数据报告情况说明项目a1 b2", "--a--_b_ -_- 　x​数据9", "x" * 30 + " " + "y" * 24]


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning")


def texts(spark):
    return spark.createDataFrame([(f"d{i % 3}", f"c{i}", t, i) for i, t in enumerate(TEXTS)], "doc_id string, chunk_id string, clean_text string, sequence int")


def test_terms_and_concepts_of_one_text_are_those_of_the_columns(spark):
    rows = texts(spark).select("clean_text", lexical_terms(F.col("clean_text")).alias("terms"), concept_candidates(F.col("clean_text")).alias("concepts")).collect()
    assert all(terms_of(r.clean_text) == r.terms and candidates_of(r.clean_text) == r.concepts for r in rows)


def test_terms_are_counted_where_chunks_are_read(spark):
    found = lexical.postings(texts(spark), keep=("doc_id",))
    assert shuffles(found) == 0 and found.columns == ["term", "chunk_id", "tf", "dl", "doc_id"]
    wanted = [(t, f"c{i}", n, sum(c.values()), f"d{i % 3}") for i, text in enumerate(TEXTS) for c in [Counter(terms_of(text))] for t, n in c.items()]
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)


def test_edges_are_counted_with_one_shuffle(spark):
    rows = texts(spark).withColumn("concepts", F.transform(graph.ranked_concepts(F.col("clean_text")), lambda c: c["concept"]))
    for by in ((), ("doc_id",)):
        found = graph.listed_edges(rows, by)
        assert shuffles(found) == 1
        slow = graph.concept_edges(graph.chunk_concepts(texts(spark), keep=by), by=by)
        wanted = Counter((*p, *(f"d{i % 3}" for _ in by)) for i, t in enumerate(TEXTS) for p in permutations({w for w, _ in Counter(candidates_of(t)).most_common(6)}, 2))
        assert {tuple(r)[:-1]: r.weight for r in found.collect()} == {tuple(r)[:-1]: r.weight for r in slow.collect()} == dict(wanted)


def test_a_tree_takes_one_shuffle(spark):
    rows = texts(spark).withColumn("chapter", F.lit("x"))
    placed = F.transform(graph.ranked_concepts(F.col("clean_text")), lambda c, i: F.struct((i + 1).alias("place"), c["concept"].alias("concept")))
    found = graph.listed_tree(rows.withColumn("ranked", placed))
    assert shuffles(found) == 1
    wanted = {f"d{d}": list(dict.fromkeys(w for t in TEXTS[d::3] for w, _ in Counter(candidates_of(t)).most_common(6))) for d in range(3)}
    assert {r.doc_id: r.concepts for r in found.collect()} == wanted
    assert {r.doc_id: r.concepts for r in graph.document_tree(rows, graph.chunk_concepts(rows)).collect()} == wanted


def test_the_waves_of_a_call_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "MOST_WAVES", 2, raising=False)
    made = Engine.create(spark, str(tmp_path / "index"))
    made.prepare(spark.createDataFrame([(f"d{i}", "n", "p", f"# T\nWord{i} twice, word{i}.") for i in range(12)], "doc_id string, name string, path string, text string"))
    before, read = made.index.manifest()["version"], []
    seen = made.index._visible
    monkeypatch.setattr(made.index, "_visible", lambda name, now: read.append(name) or seen(name, now))
    made.index.resume(made.embed, chunks_at_once=1)
    assert made.index.manifest()["version"] - before == 2 and read.count("parsed") == 1
    assert made.index.documents().filter("state = 'complete' and processed_chunks = 1").count() == 12
    assert [tuple(r) for r in made.index.statistics().collect()] == [(12, 4.0)]
    assert made.index.complete("links").select("doc_id").distinct().count() == 12


def test_plain_ingestion_embeds_chunks_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embed(text):
        calls.add(1)
        return [1.0, 0.0]

    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain", embed=lambda c: embed(c))
    made.ingest_plain(spark.createDataFrame([(f"d{i}", "apples pears") for i in range(5)], "doc_id string, text string"))
    assert calls.value == 5 and {r.weight for r in made.index.table("edges").collect()} == {5}


def test_keywords_are_scored_where_chunks_are_read(spark, monkeypatch):
    asked = [(1, "Apples and pears in 营业收入?", None), (2, "apples x9 a-b b2", "d1"), (3, "??", None), (4, "x9", "none")]
    asked = spark.createDataFrame(asked, "query_id long, question string, scope string")
    for questions in (asked, asked.drop("scope"), asked.limit(0)):
        fast = profiles.keyword_scores(questions, texts(spark))
        assert shuffles(fast) == 0
        with monkeypatch.context() as m:
            m.setattr(profiles, "TERMS_AT_ONCE", -1)  # too many terms for the tasks
            slow = profiles.keyword_scores(questions, texts(spark))
        assert fast.schema.simpleString() == slow.schema.simpleString()
        assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))


def test_digits_are_seen_in_every_character_that_normalises_to_one(spark):
    signs = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    wanted = {s for s in signs if re.search("[0-9]", unicodedata.normalize("NFKC", s))}
    found = spark.createDataFrame([(s,) for s in signs if s in wanted or ord(s) % 7 == 0 or ord(s) < 0x3400], "s string").filter(has_digits(F.concat(F.lit("aé营"), "s", F.lit("я"))))
    assert {r.s for r in found.collect()} == wanted and len(wanted) > 290


NUMBERED = ["1,234 of 10.5% in 2025", "year 2025: 12 and 34", "½ and ２０２５", "1 2 3 4, 10.5 %", "%%. 7.% .5 5. 5.5.5 %7", "٣ only", "no number", "", None, "2025", "20 25", "12.34%", "①②3 a1b2", "99 missing"]


def test_exact_numbers_are_looked_up_in_numbers_and_once_for_equal_questions(spark, monkeypatch):
    rows = spark.createDataFrame([(f"d{i % 3}", f"c{i}", t, i) for i, t in enumerate(NUMBERED * 2)], "doc_id string, chunk_id string, clean_text string, sequence int")
    asked = spark.createDataFrame([(i, t, "d1" if i % 4 == 3 else "none" if i == 8 else None) for i, t in enumerate(NUMBERED * 3)], "query_id long, question string, scope string")
    tokens = {r.query_id: set(r.t) for r in asked.select("query_id", numeric_tokens(F.col("question")).alias("t")).collect()}
    normal = {r.chunk_id: (r.doc_id, r.normal) for r in profiles.normal_chunks(rows).collect()}
    scope = {r.query_id: r.scope for r in asked.collect()}
    made, given = profiles.holding, []
    monkeypatch.setattr(profiles, "holding", lambda terms, texts, ids, col="normal": given.append(texts.select(F.col(col).alias("t"))) or made(terms, texts, ids, col))
    monkeypatch.setattr(profiles, "ALIKE_AT_ONCE", 2, raising=False)
    for questions in (asked, asked.drop("scope"), asked.limit(0), asked.filter("question = 'no number'")):
        kept = {r.query_id for r in questions.collect()}
        scoped = "scope" in questions.columns
        wanted = sorted((q, c, 0.18) for q, t in tokens.items() for c, (d, text) in normal.items() if q in kept and t and all(x in text for x in t) and (not scoped or scope[q] in (None, d)))
        small = profiles.exact_scores(questions, rows)
        with monkeypatch.context() as m:
            m.setattr(profiles, "is_small", lambda *given: False)  # too many questions for a broadcast
            large = profiles.exact_scores(questions, rows)
        assert small.schema.simpleString() == large.schema.simpleString() == "struct<query_id:bigint,chunk_id:string,score:double>"
        assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == wanted
    assert all(set(r.t) <= set("0123456789.% ") for t in given for r in t.collect())
    joined = []
    monkeypatch.setattr(profiles, "is_small", lambda df, *given: joined.append(df) or True)
    profiles.exact_scores(asked.drop("scope"), rows)
    assert any("query_ids" in df.columns and sum(len(r.query_ids) > 1 for r in df.collect()) > 3 for df in joined)


def test_the_job_counts_terms_once_and_with_their_documents(spark, tmp_path, monkeypatch):
    from jobs import document_index

    made, kept = lexical.postings, []
    monkeypatch.setattr(document_index, "postings", lambda rows, **given: kept.append(given) or made(rows, **given))
    texts(spark).select("doc_id", F.col("clean_text").alias("text")).write.parquet(str(tmp_path / "documents"))
    counts = document_index.run(spark, str(tmp_path / "documents"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert kept == [{"keep": ("doc_id",)}] and counts["documents"] == 3
    found = document_index.current(spark, str(tmp_path / "out"), "postings", "string")
    assert {(r.doc_id, r.chunk_id.partition("::")[0]) for r in found.collect()} <= {(f"d{i}", f"d{i}") for i in range(3)} and found.count() == counts["postings"]
