"""Links between chunks: section membership, adjacency, literal references."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from lodestone.operators.structure import LABEL_RE, label_of

LINK = ["doc_id", "source_id", "target_id", "kind", "basis", "status", "source_start", "source_end", "target_ids"]


def _no_targets():
    return F.array().cast("array<string>")


def _link(kind: str, **columns):
    given = {"kind": F.lit(kind), "status": F.lit("resolved"), "source_start": F.lit(0), "source_end": F.lit(0), "target_ids": _no_targets(), "target_id": F.lit(None).cast("string")} | columns
    return [given[c].alias(c) if c in given else F.col(c) for c in LINK]


def section_members(chunks: DataFrame) -> DataFrame:
    rows = chunks.filter("section_id is not null")
    return rows.select(*_link("section_member", source_id=F.col("chunk_id"), target_id=F.col("section_id"), basis=F.col("locator"), source_start=F.col("source_start"), source_end=F.col("source_end")))


def adjacent(chunks: DataFrame) -> DataFrame:
    """Both ways between consecutive chunks of one section."""
    order = Window.partitionBy("doc_id").orderBy("sequence")
    before = {c: F.lag(c).over(order) for c in ("chunk_id", "section_id", "sequence")}
    rows = chunks.select("doc_id", "chunk_id", "section_id", "sequence", *(v.alias(f"p_{k}") for k, v in before.items()))
    rows = rows.filter("section_id = p_section_id and sequence = p_sequence + 1")
    ways = F.explode(F.array(F.struct(F.col("p_chunk_id").alias("a"), F.col("chunk_id").alias("b")), F.struct(F.col("chunk_id").alias("a"), F.col("p_chunk_id").alias("b"))))
    return rows.select("doc_id", ways.alias("w")).select(*_link("adjacent", source_id=F.col("w.a"), target_id=F.col("w.b"), basis=F.lit("consecutive chunks in same section")))


_FOUND = ArrayType(StructType([StructField(n, IntegerType() if n in ("start", "end") else StringType()) for n in ("start", "end", "unit", "number", "said")]))


#: Texts whose references a task holds as Python objects at once.
TEXTS_AT_ONCE = 64


@F.arrow_udf(_FOUND)
def _references(texts: pa.Array) -> pa.Array:
    def find(text: str) -> list[dict]:
        out = []
        for m in LABEL_RE.finditer(text or ""):
            unit, number = label_of(m)
            out.append({"start": m.start(), "end": m.end(), "unit": unit, "number": number, "said": m.group()})
        return out

    kind = to_arrow_type(_FOUND)
    parts = (texts.slice(i, TEXTS_AT_ONCE).to_pylist() for i in range(0, len(texts), TEXTS_AT_ONCE))
    return pa.concat_arrays([pa.array([], kind), *(pa.array([find(t) for t in part], kind) for part in parts)])


def labels(chunks: DataFrame) -> DataFrame:
    """doc_id, unit, number and the sections so labelled (their chunk ids in order)."""
    rows = chunks.filter("section_id is not null").groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "chunk_id", "title_path"))).alias("c"))
    title = F.coalesce(F.element_at(rows.c[0]["title_path"], -1), F.lit(""))
    rows = rows.select("doc_id", F.col("c.chunk_id").alias("ids"), F.get(_references(title), 0).alias("m")).filter("m.start = 0")
    return rows.groupBy("doc_id", F.col("m.unit").alias("unit"), F.col("m.number").alias("number")).agg(F.collect_list("ids").alias("sections"))


def reference_spans(chunks: DataFrame) -> DataFrame:
    """References in runs of chunks that follow on in the source, gaps included.

    Each belongs to the chunk that holds its start; those inside the heading
    of the chunk's own section are left out.
    """
    order = Window.partitionBy("doc_id").orderBy("sequence")
    same = F.col("section_id").eqNullSafe(F.lag("section_id").over(order)) & (F.lag("source_end").over(order) + F.length("source_gap_before") == F.col("source_start"))
    rows = chunks.withColumn("opens", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    rows = rows.withColumn("said", F.concat(F.when(F.col("opens") == 0, F.col("source_gap_before")).otherwise(""), "clean_text"))
    runs = rows.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("sequence", "source_start", "chunk_id", "heading_end", "said"))).alias("c"))
    hits = runs.select("doc_id", "c", F.explode(_references(F.array_join("c.said", ""))).alias("m"))
    hits = hits.withColumn("at", F.col("c")[0]["source_start"] + F.col("m.start"))
    owner = F.element_at(F.filter("c", lambda x: x["source_start"] <= F.col("at")), -1)
    hits = hits.select("doc_id", owner.alias("o"), "at", (F.col("at") + F.col("m.end") - F.col("m.start")).alias("stop"), "m")
    return hits.filter("o.heading_end is null or at >= o.heading_end").select("doc_id", F.col("o.chunk_id").alias("source_id"), F.col("at").alias("source_start"), F.col("stop").alias("source_end"), "m.unit", "m.number", "m.said")


def references(chunks: DataFrame) -> DataFrame:
    """Resolved where one section of the document has the label, else missing or ambiguous."""
    rows = reference_spans(chunks).join(labels(chunks), ["doc_id", "unit", "number"], "left")
    one = F.size("sections") == 1
    targets = F.when(one, F.col("sections")[0]).otherwise(_no_targets())
    status = F.when(one, "resolved").when(F.col("sections").isNull(), "missing").otherwise("ambiguous")
    return rows.select(*_link("explicit_reference", target_id=F.get(targets, 0), basis=F.col("said"), status=status, source_start=F.col("source_start"), source_end=F.col("source_end"), target_ids=targets))


def build_links(chunks: DataFrame) -> DataFrame:
    return section_members(chunks).unionByName(adjacent(chunks)).unionByName(references(chunks))


def link_targets(cores: DataFrame, links: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, the link, and its target chunk (null where it has none usable).

    ``cores``: query_id, chunk_id.  Targets are looked up for resolved
    references and adjacency only, in the link's own document.
    """
    hit = cores.select("query_id", F.col("chunk_id").alias("source_id")).join(links, "source_id")
    ids = F.when(F.size("target_ids") > 0, F.col("target_ids")).otherwise(F.array("target_id"))
    usable = (F.col("status") == "resolved") & F.col("kind").isin("explicit_reference", "adjacent")
    hit = hit.withColumn("t", F.explode_outer(F.when(usable, ids)))
    targets = chunks.select(F.col("chunk_id").alias("t"), F.col("doc_id").alias("t_doc"), F.struct(*[c for c in chunks.columns if c != "embedding"]).alias("target"))
    return hit.join(targets, "t", "left").withColumn("target", F.when(F.col("t_doc") == F.col("doc_id"), F.col("target"))).drop("t", "t_doc")
