import pytest

from lodestone.__main__ import main
from lodestone.engine import Engine
from lodestone.errors import ConfigurationError
from lodestone.functions import sql
from lodestone.plans import evaluation
from lodestone.sources import sinks


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    made = Engine.create(spark, str(tmp_path_factory.mktemp("e") / "index"))
    made.ingest(spark.createDataFrame([("a", "# Section 1\nRed apples. See section 2.\n# Section 2\nStored cold."), ("b", "# Section 1\nYellow bananas.")], "doc_id string, text string"), size=50)
    return made


def data(spark):
    documents = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    queries = spark.createDataFrame([("q1", "red apples", "dev", ["a::chunk_000001"], True), ("q2", "yellow bananas", "dev", None, None)], "id string, question string, split string, reference_target_ids array<string>, reference_targets_exhaustive boolean")
    relevance = spark.createDataFrame([("q1", "a", 2), ("q2", "b", 1)], "query_id string, doc_id string, grade int")
    return documents, queries, relevance


def test_systems_side_by_side(spark, engine, tmp_path):
    documents, queries, relevance = data(spark)
    asked = evaluation.checked(documents, queries, relevance, "dev")

    def broken(_):
        raise RuntimeError("down")

    got = {r.system: r for r in evaluation.compare({"vector": evaluation.of_profile(engine, "vector"), "broken": broken}, asked, relevance).collect()}
    assert got["vector"].recall_at_5 == 1.0 and got["vector"].mrr_at_10 == 1.0 and got["vector"].failed_queries == 0
    assert got["broken"].recall_at_5 == 0.0 and got["broken"].failed_queries == 2 and got["broken"].successful_p50_seconds is None
    summary = evaluation.compare({"vector": evaluation.of_profile(engine, "vector")}, asked, relevance)
    assert "| recall_at_5 | 1.0 |" in sinks.write_report(summary, relevance, str(tmp_path / "report"), {"top_k": 10})
    with pytest.raises(Exception, match="exist"):
        sinks.write_report(summary, relevance, str(tmp_path / "report"))


def test_evidence_and_expected_points(spark, engine):
    documents, queries, relevance = data(spark)
    per, summary = evaluation.evidence(engine, evaluation.checked(documents, queries, relevance), relevance)
    assert {r.query_id: r.source_recall for r in per.collect()} == {"q1": 1.0, "q2": 1.0}
    told = {r.metric: r for r in summary.collect()}
    assert told["reference_coverage"].value == 1.0 and told["reference_coverage"].denominator == 1
    asked = spark.createDataFrame([("q", "red apples", ["RED apples", "no such"])], "query_id string, question string, expected_evidence array<string>")
    row = evaluation.expected_evidence(engine, asked, "vector").first()
    assert (row.points, row.found, row.reciprocal_rank) == (2, 1, 1.0)


def test_bad_datasets_are_refused(spark):
    documents, queries, relevance = data(spark)
    with pytest.raises(ConfigurationError, match="unknown document"):
        evaluation.checked(documents.filter("id = 'a'"), queries, relevance)
    with pytest.raises(ConfigurationError, match="no positive"):
        evaluation.checked(documents, queries, relevance.filter("doc_id = 'a'"))
    evaluation.checked(documents, queries, relevance.filter("doc_id = 'a'"), labels_required=False)


def test_sql_functions(spark):
    sql.register(spark)
    rows = spark.sql("SELECT chunk_id, clean_text FROM parse_document('# A\nb', 'd', 'md', 80)").collect()
    assert [tuple(r) for r in rows] == [("d::chunk_000000", "# A\nb")]
    assert len(spark.sql("SELECT text_embedding('abc') AS v").first().v) == 256


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "n.md").write_text("# Fruit\nGreen pears.")
    index = str(tmp_path / "index")
    assert main(["build", "--index", index, str(tmp_path / "n.md")], spark) == 0
    assert main(["ask", "--index", index, "green", "pears"], spark) == 0
    assert main(["list", "--index", index], spark) == 0
    assert "Green pears" in capsys.readouterr().out


def test_reports_have_settings_notes_and_all_metrics(spark, tmp_path):
    summary = spark.createDataFrame([("one", 0.5, None), ("two", 0.25, 1.0)], "system string, recall double, p50 double")
    text = sinks.write_report(summary, summary, str(tmp_path / "r"), {"model": "a|b", "top_k": 3}, "Comparison", ("Smoke runs show no speed.",))
    assert text.splitlines()[:3] == ["# Comparison", "", "Smoke runs show no speed."]
    for line in ("| model | a/b |", "| top_k | 3 |", "## Metrics of one", "| p50 | unavailable |", "## Metrics of two", "| p50 | 1.0 |"):
        assert line in text
    documents, queries, relevance = data(spark)
    sinks.write_dataset(documents, queries, relevance, str(tmp_path / "set"), {"excluded": documents.limit(1)})
    assert spark.read.json(str(tmp_path / "set/queries")).count() == 2 and spark.read.json(str(tmp_path / "set/audit/excluded")).count() == 1
