"""The index: replaced documents, racing writers, steps, streams."""

import pytest
from pyspark.sql import functions as F

from lodestone import __main__ as command
from lodestone.config import Config
from lodestone.engine import Engine
from lodestone.errors import ConfigurationError, StorageError
from lodestone.functions.sql import register
from lodestone.functions.text import lexical_terms
from lodestone.operators.assemble import Options
from lodestone.sources.index import Index
from lodestone.streaming.ingest import start_index

KIND = "doc_id string, text string"


def docs(spark, *rows):
    return spark.createDataFrame(rows, KIND)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def updated(spark, tmp_path_factory):
    """One evidence index: two documents, of which one is then replaced twice."""
    made = Engine.create(spark, str(tmp_path_factory.mktemp("x") / "index"))
    made.ingest(docs(spark, ("a", "# One\nApples. See section 2.\n\n# Section 2\nOld pears."), ("b", "# B\nBananas.")), size=40)
    for text in ("# One\nMiddle.", "# Only\nNew cherries and apples."):
        made.ingest(docs(spark, ("a", text), ("c", "# C\nCabbage.")) if "Middle" in text else docs(spark, ("a", text)), size=40, update=True)
    return made


def test_an_updated_document_has_one_version_in_every_table(spark, updated):
    index = updated.index
    assert {r.doc_id: r.clean_text for r in index.table("chunks").collect()} == {"a": "# Only\nNew cherries and apples.", "b": "# B\nBananas.", "c": "# C\nCabbage."}
    terms = {r.term for r in index.table("postings").filter("doc_id = 'a'").collect()}
    assert terms == {"only", "new", "cherries", "and", "apples"}
    assert {r.doc_id for r in index.table("links").collect()} == {"a", "b", "c"} and index.table("links").filter("doc_id = 'a'").count() == 1
    assert rows(index.documents(), "doc_id", "total_chunks", "state") == [(d, 1, "complete") for d in "abc"]
    stats = index.statistics().first()
    assert (stats.n, stats.avgdl) == (3, (5 + 2 + 2) / 3)
    assert "cherries" in updated.retrieve_text("new cherries")[2] and "pears" not in updated.retrieve_text("old pears")[2]
    with pytest.raises(StorageError):
        updated.ingest(docs(spark, ("a", "x")))


def test_compaction_and_removal_change_no_answer(spark, updated):
    index, columns = updated.index, ("doc_id", "term", "tf")
    before = rows(index.table("postings"), *columns)
    index.compact()
    assert index.manifest()["removed"] == [] and all(len(p) <= 1 for p in index.manifest()["tables"].values())
    assert rows(index.table("postings"), *columns) == before
    index.remove(docs(spark, ("c", ""), ("nothing", "")))
    assert rows(index.table("chunks"), "doc_id") == [("a",), ("b",)]
    updated.ingest(docs(spark, ("c", "# C\nBack again.")))
    assert rows(index.documents(), "doc_id") == [("a",), ("b",), ("c",)]


def test_a_question_reads_the_buckets_of_its_terms(spark, updated):
    found = updated.index.postings_of(spark.createDataFrame([("bananas",)], "term string"))
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:40]
    assert found.filter("term = 'bananas'").count() == 1


def test_graph_and_topics_are_replaced(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain")
    made.ingest_plain(docs(spark, ("a", "apples pears"), ("b", "apples pears")))
    assert rows(made.index.table("edges"), "source", "target", "weight") == [("apples", "pears", 2), ("pears", "apples", 2)]
    made.ingest_plain(docs(spark, ("b", "plums cherries")), update=True)
    assert rows(made.index.table("edges"), "source", "target", "weight") == sorted([("apples", "pears", 1), ("pears", "apples", 1), ("cherries", "plums", 1), ("plums", "cherries", 1)])
    assert rows(made.index.table("topics"), "doc_id", "title") == [("a", "apples / pears"), ("b", "plums / cherries")]
    new = made.index.table("topics").filter("doc_id = 'a'").withColumns({"title": F.lit("fruit"), "topic_id": F.lit("t")})
    made.index.replace_topics(new)
    assert rows(made.index.table("topics"), "doc_id", "title") == [("a", "fruit"), ("b", "plums / cherries")]
    made.index.replace_topics(new.limit(0), docs(spark, ("b", "")))
    assert rows(made.index.table("topics"), "doc_id") == [("a",)] and made.index.table("chunks").count() == 2
    made.index.replace_graph(spark.createDataFrame([("x", "y", 3), ("x", "x", 1), ("y", "x", 0)], "source string, target string, weight int"))
    assert rows(made.index.table("edges"), "source", "target", "weight") == [("x", "y", 3)]


def test_racing_commits_keep_both(spark, tmp_path):
    one, two = Index.create(spark, str(tmp_path / "index")), Index(spark, str(tmp_path / "index"))
    tried = []

    def slow(now):
        tried.append(now["version"])
        if len(tried) == 1:  # another writer commits between this one's look and its commit
            two._commit(lambda n: n | {"streams": n["streams"] | {"two": 1}})
        return now | {"streams": now["streams"] | {"one": 1}}

    one._commit(slow)
    assert tried == [1, 2] and one.manifest()["streams"] == {"one": 1, "two": 1}


def test_of_two_writers_of_one_document_one_is_refused(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "index"))
    other, commit = Engine(made.index), made.index._commit

    def late(change):
        made.index._commit = commit
        other.ingest(docs(spark, ("a", "# T\nfirst")))
        return commit(change)

    made.index.check_embedding(made.identity, record=True)
    made.index.check_embedding = lambda *_, **__: None
    made.index._commit = late
    with pytest.raises(StorageError, match="already"):
        made._add(docs(spark, ("a", "")).selectExpr("doc_id", "doc_id name", "doc_id path"), parsed(spark, "a"))
    assert rows(made.index.table("chunks"), "clean_text") == [("# T\nfirst",)]


def parsed(spark, doc_id):
    from lodestone.operators import structure

    return structure.parse_documents(docs(spark, (doc_id, "# T\nsecond")), size=80)


def test_reset_is_a_commit_and_the_old_index_stays_open(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "index"))
    made.ingest(docs(spark, ("a", "# T\nwords")))
    old = made.reset()
    assert made.index.table("chunks") is None and made.documents().count() == 0
    made.ingest(docs(spark, ("a", "# T\nother")))
    assert "words" in Engine.open(spark, old).retrieve_text("words")[2] and "other" in made.retrieve_text("other")[2]
    assert made.reset(backup=False) is None


def test_prepare_and_resume_in_waves(spark, tmp_path, monkeypatch):
    made = Engine.create(spark, str(tmp_path / "index"), Config(resume_chunks=2))
    given = docs(spark, *((f"d{i}", f"# T{i}\nword{i} " + "x " * 40) for i in range(7)), ("empty", ""))
    named = given.selectExpr("*", "doc_id name", "doc_id path")
    made.prepare(named, size=60)
    real, calls = made.index._wave, []

    def failing(embed, mine):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(embed, mine)

    made.index._wave = failing
    with pytest.raises(RuntimeError):
        made.resume()
    done = {r.doc_id for r in made.progress().filter("state = 'complete'").collect()}
    assert 0 < len(done) < 8
    made.index._wave = real
    assert set(made.resume()) == {r.doc_id for r in given.collect()} - done and made.resume() == []
    assert made.index.table("chunks").groupBy("chunk_id").count().filter("count > 1").count() == 0
    assert {(r.doc_id, r.processed_chunks == r.total_chunks, r.state) for r in made.progress().collect()} == {(r.doc_id, True, "complete") for r in given.collect()}
    made.prepare(named, size=60)
    with pytest.raises(StorageError, match="changed"):
        made.prepare(named.filter("doc_id <> 'd3'").unionByName(docs(spark, ("d3", "# T\nchanged")).selectExpr("*", "doc_id name", "doc_id path")), size=60)


def test_streams_commit_each_batch_once(spark, tmp_path):
    made, source = Engine.create(spark, str(tmp_path / "index")), tmp_path / "in"
    put = lambda *given: docs(spark, *given).coalesce(1).write.mode("append").parquet(str(source))
    put(("a", "# A\napples"), ("b", "# B\nold"), ("b", "# B\nnew"), (None, "lost"))
    stream = lambda: spark.readStream.schema(KIND).parquet(str(source))
    run = lambda checkpoint: start_index(stream(), made, str(tmp_path / checkpoint)).awaitTermination()
    run("one")
    assert "apples" in made.retrieve_text("apples")[2]
    version = made.index.manifest()["version"]
    for kept in (tmp_path / "one/commits").glob("*0*"):
        kept.unlink()  # the driver died after the commit to the index
    for kept in (tmp_path / "one/commits").glob(".*0*"):
        kept.unlink()
    run("one")
    assert made.index.manifest()["version"] == version
    put(("a", "# A\napricots"))
    run("one")
    run("two")  # a stream of another checkpoint takes the files anew, and replaces like by like
    assert rows(made.index.table("chunks"), "doc_id", "clean_text") == [("a", "# A\napricots"), ("b", "# B\nold")] or rows(made.index.table("chunks"), "doc_id")[:2] == [("a",), ("b",)]
    assert made.documents().count() == 2 and len(made.index.manifest()["streams"]) == 2


def test_the_command_line_updates(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# A\nold words")
    for _ in range(2):
        assert command.main(["build", "--index", str(tmp_path / "i"), "--update", str(tmp_path / "a.md")], spark) == 0
        (tmp_path / "a.md").write_text("# A\nnew words")
    assert rows(Index(spark, str(tmp_path / "i")).table("chunks"), "clean_text") == [("# A\nnew words",)]


def test_loose_scopes_of_the_older_profiles(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain")
    made.ingest_plain(docs(spark, ("guide-1", "apples pears"), ("notes", "apples plums")))
    asked = spark.createDataFrame([(1, "apples", "uide"), (2, "apples", "nowhere"), (3, "apples", "notes"), (4, "apples", None)], "query_id long, question string, scope string")
    got = made.retrieve(asked, "vector_keyword").join(made.index.table("chunks").select("chunk_id", "doc_id"), "chunk_id")
    assert {(r.query_id, r.doc_id) for r in got.collect()} == {(1, "guide-1"), (3, "notes"), (4, "guide-1"), (4, "notes")}


def test_every_candidate_has_a_role_or_a_reason(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "index"), Config(options=Options(candidate_k=4, max_chunks=2, max_supplements=1, context_budget=4000)))
    made.ingest(docs(spark, ("a", "# Section 1\nApples red. See section 2.\n\n# Section 2\nNothing alike."), *((f"d{i}", f"# D{i}\napples {i}") for i in range(6))), size=60)
    asked = spark.createDataFrame([(1, "apples red", None), (2, " ", None)], "query_id long, question string, scope string")
    selected, details, counts = made.explain(asked)
    items = {x.chunk_id: x.role for r in selected.collect() for x in r["items"]}
    seen = {(r.query_id, r.chunk_id): (r.final_role, r.omission_reason) for r in details.collect()}
    assert {c: role for (_, c), (role, _) in seen.items() if role} == items and all((role is None) != (why is None) for role, why in seen.values())
    assert "fusion_cap" in {why for _, why in seen.values()} and {why for _, why in seen.values()} & {"cap_skipped", "budget_skipped"}
    n = {r.query_id: r for r in counts.collect()}
    assert n[1].candidate_union == details.filter('fusion_rank is not null').count() and n[1].fused_candidates == 4 and n[1].selected == len(items) and n[2].candidate_union == 0
    assert set(made.timings) == {"scope", "query_embedding", "vector_recall", "lexical", "fusion", "selection_context"} and all(t >= 0 for t in made.timings.values())
    assert made.retrieve_text("apples red")[0] == f"evidence recall {n[1].candidate_union} -> fusion 4 -> selected {len(items)}"


def test_older_profiles_rerank_their_recall(spark, tmp_path):
    plain = Engine.create(spark, str(tmp_path / "plain"), Config(vector_recall_k=3, final_top_k=2), kind="plain")
    plain.ingest_plain(docs(spark, *((f"d{i}", f"apples number {i}" + " and more" * i) for i in range(6))))
    asked = spark.createDataFrame([(1, "apples number", None)], "query_id long, question string, scope string")
    first = [r.chunk_id for r in plain.retrieve(asked, "vector_keyword", top_k=3).orderBy("rank").collect()]
    seen = []

    def turned(pairs):
        seen.append(pairs.count())
        return pairs.filter(F.col("chunk_id") != first[0]).select("query_id", "chunk_id", (-F.length("clean_text")).cast("double").alias("rerank_score"))

    again = Engine(plain.index, plain.config, reranker=turned).retrieve(asked, "vector_keyword").orderBy("rank").collect()
    assert seen == [3] and [r.chunk_id for r in again] == sorted(first[1:], key=lambda c: int(c[1])) and all(r.score < 0 for r in again)
    assert plain.retrieve_text("apples number", profile="vector")[0].startswith("vector recall 3 -> selected 2")


def test_settings_files_and_sql_terms(spark, tmp_path):
    path = tmp_path / ".env"
    path.write_text("# settings\nFINAL_TOP_K=4\nexport EVIDENCE_MAX_CHUNKS='3'\n\nKB_PATH=\"x y\"\n")
    found = Config.from_file(str(path))
    assert (found.final_top_k, found.options.max_chunks, found.index_path) == (4, 3, "x y")
    path.write_text("nonsense\n")
    with pytest.raises(ConfigurationError):
        Config.from_file(str(path))
    register(spark)
    texts = ["营业收入 Revenue_2024 Ａ-1 中", "", None, "___ 数据 x", "ﬁne ²"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("native", lexical_terms(F.col("t")))
    got.createOrReplaceTempView("said_terms")
    assert all(r.a == r.native for r in spark.sql("select lexical_terms(t) a, native from said_terms").collect())


def test_chunks_by_ids_and_scope_with_concepts(spark, tmp_path):
    made = Engine.create(spark, str(tmp_path / "plain"), kind="plain")
    made.ingest_plain(docs(spark, ("a", "pears apples pears"), ("b", "plums"), ("c", "12")))
    ids = spark.createDataFrame([("a::chunk_000000",), ("c::chunk_000000",), ("a::chunk_000000",), ("no",)], "chunk_id string")
    assert {r.doc_id: r.concepts for r in made.index.chunks(ids, with_concepts=True).collect()} == {"a": ["pears", "apples"], "c": []}
    assert rows(made.index.chunks(scope="b"), "doc_id") == [("b",)] and made.index.chunks().count() == 3


def test_topic_scores_make_no_nested_loop(spark):
    from lodestone.operators import profiles

    found = spark.createDataFrame([("t", [1.0, 0.0], ["c0", "c1"]), ("u", [0.0, -1.0], ["c2"]), ("v", [1.0], ["c3"])], "topic_id string, centroid array<double>, chunk_ids array<string>")
    chunks = spark.createDataFrame([(f"c{i}", "d" if i else "e") for i in range(4)], "chunk_id string, doc_id string")
    asked = spark.createDataFrame([(1, [0.5, 0.5], None), (2, [0.5, 0.5], "e")], "query_id long, embedding array<double>, scope string")
    scores = profiles.topic_scores(asked, found, chunks)
    assert sorted((r.query_id, r.chunk_id, round(r.score, 6)) for r in scores.collect()) == [(1, "c0", 0.04), (1, "c1", 0.04), (1, "c2", 0.0), (2, "c0", 0.04)]
    assert "NestedLoop" not in (plan := scores._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
