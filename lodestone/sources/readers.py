"""Sources: documents and datasets as DataFrames.

Files are read by the engine (binaryFile keeps CRLF and works on any store)
and parsed in Arrow batches; nothing is opened by path on an executor.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ParseError
from lodestone.functions.text import document_id, strip
from lodestone.operators.structure import CHUNK_FIELDS, parse_pages, parse_paragraphs, parse_text

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(content: bytes) -> list[tuple[str, int | None]]:
    """(text, heading level) of the body's paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in package.namelist():
            for style in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{_W}style"):
                name = style.find(f"{_W}name")
                names[style.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    out = []
    for paragraph in body.findall(f"{_W}p"):
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        level = re.fullmatch(r"heading\s*([1-9])", name or "", re.IGNORECASE)
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        text = "".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts and not (e.tag == f"{_W}tab" and not e.attrib == {}))
        out.append((text, int(level[1]) if level else None))
    return out


def pdf_pages(content: bytes) -> list[str]:
    """Page texts through pypdf, if it is installed; other extractors can be given."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise ParseError("reading PDF needs pypdf or an extractor of your own") from missing
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def page_marked(pages: list[str]) -> str:
    """Page texts as one, each after a line that gives its number."""
    return "\n".join(f"[[PAGE:{n}]]\n{text}" for n, text in enumerate(pages, 1))


def parse_bytes(content: bytes, suffix: str, doc_id: str, size: int, pages_of: Callable[[bytes], list[str]] = pdf_pages) -> list[dict]:
    try:
        if suffix in ("md", "txt"):
            return parse_text(content.decode("utf-8"), doc_id, suffix, size)
        if suffix == "docx":
            return parse_paragraphs(docx_paragraphs(content), doc_id, size)
        if suffix == "pdf":
            return parse_pages(pages_of(content), doc_id, size)
    except ParseError:
        raise
    except Exception as why:
        raise ParseError(f"cannot read {doc_id}") from why
    raise ParseError(f"unsupported document type: {suffix or 'none'}")


def plain_text(content: bytes, suffix: str, pages_of: Callable[[bytes], list[str]] = pdf_pages) -> str:
    """The unstructured text of a file, PDF pages marked."""
    if suffix in ("md", "txt"):
        return content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    if suffix == "docx":
        return "\n".join(p for p, _ in docx_paragraphs(content))
    if suffix == "pdf":
        return page_marked(pages_of(content))
    raise ParseError(f"unsupported document type: {suffix or 'none'}")


def files(spark: SparkSession, *paths: str) -> DataFrame:
    """doc_id, name, path, suffix, content of files."""
    raw = spark.read.format("binaryFile").load(list(paths))
    clean = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?/+", "/")
    return raw.select(document_id(clean).alias("doc_id"), F.regexp_extract(clean, "([^/]*)$", 1).alias("name"), clean.alias("path"), F.lower(F.regexp_extract(clean, r"\.([^./]*)$", 1)).alias("suffix"), "content")


def parse_files(found: DataFrame, size: int = 800, pages_of: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """doc_id and chunk columns of every file."""
    names = ["doc_id", *(f.split()[0] for f in CHUNK_FIELDS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"doc_id": i, **c} for i, s, b in zip(batch["doc_id"], batch["suffix"], batch["content"], strict=True) for c in parse_bytes(bytes(b), s, i, size, pages_of)]
            made = pd.DataFrame(rows, columns=names)
            yield made.assign(heading_end=made["heading_end"].astype("Int32"))

    return found.select("doc_id", "suffix", "content").mapInPandas(run, f"doc_id string, {CHUNK_FIELDS}")


def load_texts(found: DataFrame, pages_of: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """doc_id, name, path, text."""

    @F.pandas_udf("string")
    def text(suffix: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([plain_text(bytes(c), s, pages_of) for s, c in zip(suffix, content, strict=True)])

    return found.select("doc_id", "name", "path", text("suffix", "content").alias("text"))


def strict_json(text: str) -> dict | list:
    """JSON without repeated keys and without NaN or infinities."""

    def unique(pairs: list) -> dict:
        made = dict(pairs)
        if len(made) < len(pairs):
            raise ValueError("a key occurs twice")
        return made

    def refuse(name: str):
        raise ValueError(f"{name} is not allowed")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


DATASET = (
    "name string, purpose string, documents array<struct<id: string, text: string, format: string>>, "
    "queries array<struct<id: string, question: string, split: string, doc_scope: string, relevant_documents: map<string, int>, reference_target_ids: array<string>, reference_targets_exhaustive: boolean>>"
)


def dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, relevance) of an inline evaluation dataset."""
    raw = spark.read.schema(DATASET).option("multiLine", True).json(path)
    documents = raw.select(F.explode("documents").alias("d")).select("d.*", F.concat(F.lit("inline:"), "d.id").alias("path"))
    queries = raw.select(F.explode("queries").alias("q")).select("q.*")
    relevance = queries.select(F.col("id").alias("query_id"), F.explode("relevant_documents").alias("doc_id", "grade"))
    return documents, queries, relevance


def questions_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, distinct documents in first-use order) of a profile evaluation."""
    raw = spark.read.schema("id string, document string, question string, expected_evidence array<string>, top_k int").option("multiLine", True).json(path)
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    return rows.drop("at"), rows.groupBy("document").agg(F.min("at").alias("at")).orderBy("at").select("document")


LEGACY = (
    "schema_version int, documents map<string, struct<id: string, name: string, path: string, chunk_ids: array<string>>>, "
    "chunks map<string, struct<id: string, doc_id: string, chapter: string, concepts: array<string>, clean_text: string, text: string, embedding: array<float>>>, "
    "knowledge_graph map<string, map<string, int>>, processed_chunks map<string, int>, "
    "topic_index map<string, struct<topics: map<string, struct<id: string, doc_id: string, title: string, chunk_ids: array<string>, centroid: array<float>>>, chunk_to_topic: map<string, string>>>"
)


def legacy_knowledge_base(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents, chunks, edges and topics of a one-file knowledge base."""
    raw = spark.read.schema(LEGACY).option("multiLine", True).json(path)
    entries = lambda c: raw.select(F.explode(c).alias("key", "v"))
    done = raw.select(F.explode("processed_chunks").alias("doc_id", "processed_chunks"))
    documents = entries("documents").select(F.coalesce("v.id", "key").alias("doc_id"), "v.name", "v.path", "v.chunk_ids").join(done, "doc_id", "left")
    place = documents.select("doc_id", F.posexplode("chunk_ids").alias("sequence", "chunk_id"))
    chunks = entries("chunks").select(F.coalesce("v.id", "key").alias("chunk_id"), "v.chapter", F.coalesce("v.concepts", F.array().cast("array<string>")).alias("concepts"), "v.clean_text", F.coalesce("v.text", "v.clean_text").alias("context_text"), "v.embedding").join(place, "chunk_id")
    edges = entries("knowledge_graph").select(F.col("key").alias("source"), F.explode("v").alias("target", "weight")).filter("source <> target and weight > 0")
    topics = raw.select(F.explode("topic_index").alias("key", "i")).select(F.explode("i.topics").alias("topic_id", "t")).select("topic_id", "t.doc_id", "t.title", "t.centroid", "t.chunk_ids")
    return {"documents": documents.drop("chunk_ids").withColumn("processed_chunks", F.coalesce("processed_chunks", F.lit(0))), "chunks": chunks, "edges": edges, "topics": topics}


#: The question lists of the news collection and their numbers of articles.
TASKS = {"questanswer_1doc": 1, "questanswer_2docs": 2, "questanswer_3docs": 3}


def news_questions(spark: SparkSession, path: str) -> DataFrame:
    """task, row_index, event_id, question, news (array), reason if unusable."""
    row = "array<struct<ID: string, questions: string, answers: string, thoughts: string, news1: string, news2: string, news3: string>>"
    raw = spark.read.schema(", ".join(f"{t} {row}" for t in TASKS)).option("multiLine", True).json(path)
    out = None
    for task, n in TASKS.items():
        rows = raw.select(F.posexplode(task).alias("row_index", "r"))
        empty = lambda c: F.coalesce(strip(c), F.lit("")) == ""
        reason = F.when(empty(F.col("r.ID")), "missing_event_id").when(empty(F.col("r.questions")), "missing_or_empty_questions")
        for i in range(1, n + 1):
            reason = reason.when(empty(F.col(f"r.news{i}")), f"missing_or_empty_news{i}")
        rows = rows.select(F.lit(task).alias("task"), "row_index", F.col("r.ID").alias("event_id"), strip(F.col("r.questions")).alias("question"), F.array(*[strip(F.col(f"r.news{i}")) for i in range(1, n + 1)]).alias("news"), reason.alias("reason"))
        out = rows if out is None else out.unionByName(rows)
    return out


def pilot_audit(rows: DataFrame) -> dict[str, DataFrame]:
    """What the pilot's source holds: rows per task, excluded rows, incomplete and complete events."""
    kinds = rows.filter("reason is null").groupBy("event_id").agg(F.countDistinct("task").alias("n"))
    return {
        "source_rows": rows.groupBy("task").agg(F.count(F.lit(1)).alias("n")),
        "excluded_rows": rows.filter("reason is not null").select("task", "row_index", "event_id", "reason"),
        "incomplete_events": kinds.filter(F.col("n") < len(TASKS)).select("event_id"),
        "complete_events": kinds.filter(F.col("n") == len(TASKS)).select("event_id"),
    }


def prepare_pilot(rows: DataFrame, query_events: int = 10, corpus_events: int = 100, seed: int = 20260918) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, relevance) from complete events, chosen by a seeded hash.

    An event is complete when each task has a usable row for it.  Equal texts
    become one document, with every use listed in ``sources``.  A task without
    rows, an event that a task lists twice and fewer complete events than
    ``corpus_events`` are errors.
    """
    if type(query_events) is not int or type(corpus_events) is not int or not 0 < query_events <= corpus_events:
        raise ValueError("query_events must lie between 1 and corpus_events")
    repeated = rows.filter("event_id is not null").filter(strip(F.col("event_id")) != "").groupBy("task", "event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy("task", "event_id").first()
    if repeated:
        raise ValueError(f"duplicate event ID in {repeated.task}: {repeated.event_id}")
    missing = set(TASKS) - {r.task for r in rows.select("task").distinct().collect()}
    if missing:
        raise ValueError(f"missing task list: {min(missing)}")
    good = rows.filter("reason is null")
    events = good.groupBy("event_id").agg(F.countDistinct("task").alias("n")).filter(F.col("n") == len(TASKS)).select("event_id")
    if (found := events.count()) < corpus_events:
        raise ValueError(f"only {found} complete events; requested {corpus_events}")
    chosen = events.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "event_id")), "event_id").limit(corpus_events)
    asked = events.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "event_id")), "event_id").limit(query_events).withColumn("asked", F.lit(True))
    used = good.join(chosen, "event_id").join(asked, "event_id", "left")
    texts = used.select("event_id", "task", "row_index", "question", "asked", F.posexplode("news").alias("i", "text"))
    source = F.struct("event_id", "task", "row_index", F.concat(F.lit("news"), (F.col("i") + 1).cast("string")).alias("field"))
    documents = texts.groupBy("text").agg(F.array_sort(F.collect_list(source)).alias("sources")).select(F.concat(F.lit("news-"), F.substring(F.sha2("text", 256), 1, 16)).alias("id"), "text", "sources")
    queries = used.filter("asked").select(F.concat_ws(":", "task", "event_id").alias("id"), "event_id", F.col("task").alias("source_task"), F.col("row_index").alias("source_row_index"), "question", F.lit("dev").alias("split"))
    relevance = texts.filter("asked").join(documents.select("id", "text"), "text").select(F.concat_ws(":", "task", "event_id").alias("query_id"), F.col("id").alias("doc_id"), F.lit(1).alias("grade")).distinct()
    return documents, queries, relevance
