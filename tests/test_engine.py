import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.engine import Engine, answer, answer_messages
from lodestone.errors import ConfigurationError, ParseError, ScopeError, StorageError
from lodestone.functions import embedding
from lodestone.operators import graph, rerank
from lodestone.sources import readers
from lodestone.sources.index import Index
from lodestone.sources.scratch import broadcast_if_small

GUIDE = "# Section 1\nApples are red. See section 2.\n\n# Section 2\nPears are green and 12.5 percent sweeter.\n"
NOTES = "# Section 1\nBananas are yellow. See clause 9.\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine.create(spark, str(tmp_path_factory.mktemp("x") / "index"))
    made.ingest(spark.createDataFrame([("guide", GUIDE, "Guide"), ("notes", NOTES, "Notes")], "doc_id string, text string, name string"), size=60)
    return made


def ask(spark, *rows):
    return spark.createDataFrame(rows, "query_id long, question string, scope string")


def test_evidence_with_supplement_and_scope(spark, engine):
    got = {r.query_id: r for r in engine.retrieve(ask(spark, (1, "apples red", None), (2, "apples red", "Notes"), (3, "  ", None))).collect()}
    assert got[1]["status"] == "ok" and got[1]["items"][0].chunk_id.startswith("guide::")
    assert {x.chunk_id.split("::")[0] for x in got[2]["items"]} == {"notes"}
    assert got[3]["status"] == "no_candidates" and got[3]["context"] == ""
    path, ids, context = engine.retrieve_text("pears green", "guide")
    assert "Pears are green" in context and ids and path.startswith("evidence")


def test_scopes_and_profiles_are_checked(spark, engine):
    with pytest.raises(ScopeError):
        engine.retrieve(ask(spark, (1, "x", "nowhere")))
    with pytest.raises(StorageError):
        engine.retrieve(ask(spark, (1, "x", None)), "full")
    with pytest.raises(ConfigurationError):
        engine.check_profile("other")
    with pytest.raises(ValueError):
        engine.retrieve_semantic("x", mode="other")
    with pytest.raises(StorageError):
        Engine.create(spark, engine.index.path)
    with pytest.raises(ConfigurationError):
        Engine.open(spark, engine.index.path, Config(embedding_model="other"))
    assert engine.retrieve(ask(spark, (1, "apples", None)).drop("scope"), "vector").count() == 3


def test_reranker_changes_order_and_drops(spark, engine):
    only = lambda pairs: pairs.filter(F.col("clean_text").contains("Bananas")).select("query_id", "chunk_id", F.lit(1.0).alias("rerank_score"))
    with_one = Engine(engine.index, reranker=only)
    assert [x.chunk_id.split("::")[0] for x in with_one.retrieve(ask(spark, (1, "apples red", None))).first()["items"]] == ["notes"]


def test_models_are_callables(spark, engine):
    def load():
        return lambda pairs: [float(len(set(q.split()) & set(p.lower().split()))) for q, p in pairs]

    with_one = Engine(engine.index, reranker=rerank.pairwise(load, 2))
    assert with_one.retrieve(ask(spark, (1, "bananas are yellow.", None))).first()["items"][0].chunk_id.startswith("notes::")
    embed = embedding.from_encoder(lambda: lambda texts: [[3.0, 4.0] for _ in texts], 1)
    rows = spark.createDataFrame([("a",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert [list(r.v) for r in rows] == [[0.6, 0.8]] * 2
    for bad in (rerank.pairwise, embedding.from_encoder):
        with pytest.raises(ValueError):
            bad(load, 0)


def test_plain_index_serves_every_profile(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain")
    made.ingest_plain(spark.createDataFrame([("a", "营业收入增长明显，营业收入达到100万元。"), ("b", "apples and pears and apples")], "doc_id string, text string"))
    for name in ("vector", "vector_keyword", "vector_graph", "vector_topic_graph", "full"):
        first = made.retrieve(ask(spark, (1, "营业收入 100", None)), name).orderBy("rank").first()
        assert first.chunk_id == "a::chunk_000000", name
    assert made.retrieve_semantic("apples")[1].startswith("b::")
    assert {r.doc_id: r.concepts for r in made.tree().collect()}["b"] == ["apples", "and", "pears"]


def test_prepare_resume_and_replay(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "index"), Config(batch_size=1))
    docs = spark.createDataFrame([("guide", GUIDE, "g", "/g"), ("none", "", "n", "/n")], "doc_id string, text string, name string, path string")
    made.prepare(docs, size=60)
    made.prepare(docs, size=60)
    with pytest.raises(StorageError):
        made.prepare(docs.withColumn("text", F.concat("text", F.lit("more"))), size=60)
    with pytest.raises(StorageError):
        made.check_profile("evidence")
    rows = made.index.table("parsed").filter("sequence = 0").withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    with pytest.raises(StorageError):
        made.index.write_batch("guide", rows, 1, 2)
    with pytest.raises(StorageError):
        made.index.write_batch("guide", rows.withColumn("embedding", F.array(F.lit(float("nan")))), 0, 1)
    assert made.resume() == ["guide", "none"] and made.resume() == []
    made.index.write_batch("guide", rows, 0, 1)
    assert [(r.doc_id, r.processed_chunks, r.state) for r in made.progress().collect()] == [("guide", 2, "complete"), ("none", 0, "complete")]
    assert made.index.complete("chunks").count() == 2
    old = made.reset()
    assert made.index.capabilities()["vector"] is False and Index(spark, old).capabilities()["evidence_ready"]


def docx(*paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# T\r\nbody\r\n")
    (tmp_path / "b.docx").write_bytes(docx(("Title", "H1"), ("text", None)))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    found = readers.files(spark, str(tmp_path))
    rows = readers.parse_files(found, 100, pages_of=lambda b: ["one", "two"]).orderBy("doc_id", "sequence").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id[0], []).append(r)
    assert (by["a"][0].clean_text, by["a"][0].locator, by["a"][0].title_path) == ("# T\r\nbody", "lines 1-2", ["T"])
    assert (by["b"][0].clean_text, by["b"][0].locator) == ("Title\ntext", "paragraphs 1-2")
    assert [r.locator for r in by["c"]] == ["page 1", "page 2"] and by["c"][0].section_id is None
    texts = {r.name: r.text for r in readers.load_texts(found, lambda b: ["p"]).collect()}
    assert texts == {"a.md": "# T\nbody\n", "b.docx": "Title\ntext", "c.pdf": "[[PAGE:1]]\np"}
    with pytest.raises(ParseError):
        readers.parse_bytes(b"", "xls", "d", 10)
    with pytest.raises(ParseError):
        readers.parse_bytes(b"not a zip", "docx", "d", 10)


def test_json_sources(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.strict_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        readers.strict_json('{"a": NaN}')
    data = {"name": "n", "purpose": "smoke", "documents": [{"id": "d", "text": "t"}], "queries": [{"id": "q", "question": "?", "split": "dev", "relevant_documents": {"d": 2}}]}
    (tmp_path / "set.json").write_text(json.dumps(data))
    documents, queries, relevance = readers.dataset(spark, str(tmp_path / "set.json"))
    assert documents.first().path == "inline:d" and queries.first().split == "dev" and tuple(relevance.first()) == ("q", "d", 2)
    base = {"schema_version": 1, "documents": {"d": {"id": "d", "name": "n", "path": "p", "chunk_ids": ["c0", "c1"]}}, "chunks": {c: {"id": c, "doc_id": "d", "chapter": "x", "concepts": ["k"], "clean_text": c, "text": "ctx", "embedding": [1.0, 0.0]} for c in ("c0", "c1")}, "knowledge_graph": {"k": {"l": 2, "k": 5}}, "topic_index": {"d": {"topics": {"t": {"id": "t", "doc_id": "d", "title": "T", "chunk_ids": ["c0"], "centroid": [1.0]}}, "chunk_to_topic": {"c0": "t"}}}, "processed_chunks": {"d": 2}}
    (tmp_path / "kb.json").write_text(json.dumps(base))
    tables = readers.legacy_knowledge_base(spark, str(tmp_path / "kb.json"))
    assert [(r.chunk_id, r.sequence) for r in tables["chunks"].orderBy("sequence").collect()] == [("c0", 0), ("c1", 1)]
    assert [tuple(r) for r in tables["edges"].collect()] == [("k", "l", 2)] and tables["documents"].first().processed_chunks == 2 and tables["topics"].first().title == "T"


def test_news_pilot(spark, tmp_path):
    row = lambda e, n, t: {"ID": e, "questions": f"q{e}", **{f"news{i}": f"{t} {i}" for i in range(1, n + 1)}}
    data = {task: [row(e, n, "same" if e == "e1" else e) for e in ("e1", "e2", "e3")] for task, n in readers.TASKS.items()}
    data["questanswer_2docs"][2]["news2"] = " "
    (tmp_path / "news.json").write_text(json.dumps(data))
    rows = readers.news_questions(spark, str(tmp_path / "news.json"))
    assert [(r.event_id, r.reason) for r in rows.filter("reason is not null").collect()] == [("e3", "missing_or_empty_news2")]
    documents, queries, relevance = readers.prepare_pilot(rows, 1, 2)
    assert documents.count() == 6 and queries.count() == 3 and relevance.count() == 6
    assert sum(len(r.sources) for r in documents.collect()) == 12
    audit = {k: v.count() for k, v in readers.pilot_audit(rows).items()}
    assert audit == {"source_rows": 3, "excluded_rows": 1, "incomplete_events": 1, "complete_events": 2}
    with pytest.raises(ValueError, match="only 2 complete events"):
        readers.prepare_pilot(rows, 1, 3)
    with pytest.raises(ValueError, match="duplicate event ID in questanswer_1doc: e1"):
        readers.prepare_pilot(rows.unionByName(rows.filter("task = 'questanswer_1doc' and event_id = 'e1'")), 1, 2)
    with pytest.raises(ValueError, match="missing task list: questanswer_3docs"):
        readers.prepare_pilot(rows.filter("task <> 'questanswer_3docs'"), 1, 2)


def test_broadcast_only_after_a_check_of_rows_and_bytes(spark):
    rows = spark.range(5).withColumn("text", F.repeat(F.lit("x"), 100))
    plan = lambda df: df._jdf.queryExecution().toString()
    assert "broadcast" in plan(broadcast_if_small(rows))
    assert "broadcast" not in plan(broadcast_if_small(rows, most=4)) and "broadcast" not in plan(broadcast_if_small(rows, most_bytes=400))
    assert "broadcast" in plan(broadcast_if_small(rows.limit(0)))


def test_a_reranker_that_the_settings_ask_for_must_be_given(spark, tmp_path):
    with pytest.raises(ConfigurationError, match="reranker"):
        Engine.create(spark, str(tmp_path / "asked"), Config(enable_reranker=True))


def test_settings():
    assert Config.load({"EVIDENCE_MAX_CHUNKS": "3", "FINAL_TOP_K": "4"}).options.max_chunks == 3
    for bad in ({"EVIDENCE_MAX_CHUNKS": "0"}, {"FINAL_TOP_K": "x"}, {"RETRIEVAL_PROFILE": "other"}):
        with pytest.raises(ConfigurationError):
            Config.load(bad)
    assert answer(lambda m: f" {len(m)} ", "q", "c") == "2" and "c" in answer_messages("q", "c")[1]["content"]


def test_edges_of_two_ingests_are_summed(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain")
    for name in ("a", "b"):
        made.ingest_plain(spark.createDataFrame([(name, "apples pears")], "doc_id string, text string"))
    edges = made.index.table("edges")
    assert sorted(map(tuple, edges.collect())) == [("apples", "pears", 2), ("pears", "apples", 2)]
    stored = edges.unionByName(edges)
    assert {r.source: r.targets for r in graph.adjacency(stored).collect()} == {"apples": {"pears": 4}, "pears": {"apples": 4}}


def test_white_space_is_no_question(spark, engine):
    assert engine.retrieve(ask(spark, (1, "\t\n", None))).first()["status"] == "no_candidates"
