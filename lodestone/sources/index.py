"""The index: Parquet tables in a folder, visible through its newest manifest only.

Every write goes to a part, a data folder of its own name; then a manifest of
the next number, which lists the parts, is put beside the old ones.  A reader
sees what one manifest lists, so an interrupted write leaves no trace.  A
number is given out once: a writer that finds it taken looks at the index
again, with its checks, and takes the next.

Documents are replaced by ids: a part of removed ids hides the rows that older
parts have for them, by a join when a table is read, until ``compact`` writes
what is left.  Tables with rows of documents carry doc_id, the concept graph
included, so that a document takes its edges with it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import ConfigurationError, ScopeError, StorageError
from lodestone.functions.embedding import valid
from lodestone.operators import scopes
from lodestone.operators.lexical import postings
from lodestone.operators.links import build_links
from lodestone.sources.scratch import broadcast_if_small, saved

VERSION = 2
TABLES = ("parsed", "prepared", "chunks", "postings", "links", "documents", "concepts", "edges", "topics")
#: Folders that a part of postings is split into by term, so that a question reads those of its terms.
BUCKETS = 16
#: Times a commit is tried again after others came first.
TRIES = 20
#: Waves of one call that completes documents: the cost of their jobs and commits does not grow with the documents.
MOST_WAVES = 16


@dataclass
class Wave:
    """Documents to complete together, by a manifest: their parsed chunks, each with whether it is ``held`` already, and whether any is."""

    now: dict
    docs: DataFrame
    rows: DataFrame
    begun: bool


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _newest(self):
        fs, p = self._fs(f"{self.path}/manifest-*.json")
        found = fs.globStatus(p)
        return fs, max((f.getPath() for f in found or ()), key=lambda p: p.getName(), default=None)

    def exists(self) -> bool:
        return self._newest()[1] is not None

    def manifest(self) -> dict:
        fs, newest = self._newest()
        if newest is None:
            raise StorageError(f"no index at {self.path}")
        stream = fs.open(newest)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _put(self, manifest: dict) -> bool:
        """Whether the manifest's number was free and now is this one's."""
        fs, temp = self._fs(f"{self.path}/.manifest-{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest-{manifest['version']:012d}.json")
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(temp), fs.makeQualified(final), how)
        except Py4JJavaError as why:
            fs.delete(temp, False)
            if "FileAlreadyExists" in why.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, change: Callable[[dict], dict | None]) -> dict:
        """Puts what ``change`` makes of the newest manifest in its place; None leaves it.

        ``change`` checks what it needs and may be called again, with a newer one.
        """
        for _ in range(TRIES):
            now = self.manifest()
            now["version"] += 1
            new = change(now)
            if new is None or self._put(new):
                return new or now
        raise StorageError(f"{TRIES} commits came first")

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, kind: str = "evidence") -> Index:
        made = cls(spark, path)
        fs, p = made._fs(made.path)
        if fs.exists(p):
            raise StorageError(f"{path} exists")
        fs.mkdirs(p)
        if not made._put(made._empty(kind)):
            raise StorageError(f"{path} exists")
        return made

    @staticmethod
    def _empty(kind: str, version: int = 0) -> dict:
        return {"schema_version": VERSION, "version": version, "index_kind": kind, "embedding": None, "tables": {t: [] for t in TABLES}, "removed": [], "streams": {}}

    def reset(self, backup: bool = True) -> str | None:
        """Empty the index, as one more manifest; what it held can be opened at the path returned, if asked."""
        to = None
        if backup:
            to = f"{self.path}.backup-{datetime.now(UTC):%Y%m%d%H%M%S%f}"
            old, was = Index(self.spark, to), self.manifest()
            fs, p = old._fs(to)
            fs.mkdirs(p)
            old._put(was | {"root": was.get("root", self.path)})
        self._commit(lambda now: self._empty(now["index_kind"], now["version"]))
        return to

    def check_embedding(self, identity: str, record: bool = False) -> None:
        """The backend and model that made the vectors must stay the same."""

        def checked(now: dict) -> dict | None:
            if now["embedding"] not in (None, identity):
                raise ConfigurationError(f"the index was embedded with {now['embedding']}, not {identity}")
            return now | {"embedding": identity} if record and now["embedding"] is None else None

        self._commit(checked)

    # -- writing

    def _write(self, df: DataFrame, table: str) -> str:
        """A new part, which is a partition of the table's folder."""
        name = f"{table}/part=p{uuid.uuid4().hex}"
        if table == "postings":
            df.withColumn("bucket", bucket(F.col("term"))).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/{name}")
        else:
            df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return name

    def _listed(self, now: dict, parts: dict[str, str], removed: str | None = None) -> dict:
        for table, name in parts.items():
            now["tables"].setdefault(table, []).append([name, now["version"]])
        if removed:
            now["removed"].append([removed, now["version"]])
        return now

    def _read(self, names: list[str], now: dict) -> DataFrame:
        """Parts of one table, with a column ``part``."""
        root = now.get("root", self.path)
        return self.spark.read.option("basePath", f"{root}/{names[0].partition('/')[0]}").parquet(*(f"{root}/{n}" for n in names))

    def _checked(self, chunks: DataFrame, known: int | None) -> tuple[str, int | None]:
        """A part of chunks and the dimension of their vectors, which must be there, finite and alike; seen as they are written."""
        seen = Observation()
        sizes = F.size("embedding")
        bad = F.count(F.when(~F.coalesce(valid(F.col("embedding")), F.lit(False)), 1))
        written = self._write(chunks.observe(seen, bad.alias("bad"), F.min(sizes).alias("least"), F.max(sizes).alias("most")), "chunks")
        found = seen.get
        if found["bad"] or found["least"] != found["most"] or None not in (found["least"], known) and found["least"] != known:
            raise StorageError("vectors must be there, finite and of one dimension")
        return written, found["least"] or known

    def _chunk_parts(self, chunks: DataFrame, with_links: bool = True) -> tuple[dict[str, str], int | None, DataFrame]:
        """Parts of chunks, their postings and links; the vectors' dimension; chunks and terms of each document."""
        now = self.manifest()
        written, size = self._checked(chunks, now.get("dimension"))
        rows = self._part("chunks", written, chunks)
        parts, seen = {"chunks": written}, Observation()
        terms = self._write(postings(rows, keep=("doc_id",)).observe(seen, F.count(F.lit(1)).alias("n")), "postings")
        if seen.get["n"]:  # a table split by folders has no schema without a row
            parts["postings"] = terms
        if with_links:
            parts["links"] = self._write(build_links(rows), "links")
        terms = self._terms(parts).groupBy("doc_id").agg(F.sum("tf").alias("total_terms"))
        totals = rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks")).join(terms, "doc_id", "left")
        return parts, size, totals

    def _part(self, table: str, name: str, like: DataFrame) -> DataFrame:
        """A part just written from ``like``."""
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def _terms(self, parts: dict[str, str]) -> DataFrame:
        """doc_id and tf of a new part of postings, if there is one."""
        part = parts.get("postings")
        return self.spark.read.parquet(f"{self.path}/{part}").select("doc_id", "tf") if part else self.spark.createDataFrame([], "doc_id string, tf long")

    def _with_totals(self, documents: DataFrame, totals: DataFrame) -> DataFrame:
        rows = documents.select("doc_id", "name", "path").join(totals, "doc_id", "left")
        return rows.withColumns({"total_chunks": F.coalesce("total_chunks", F.lit(0)), "total_terms": F.coalesce("total_terms", F.lit(0)).cast("long")})

    def add_all(self, documents: DataFrame, chunks: DataFrame, with_links: bool = True, update: bool = False, batch: tuple[str, int] | None = None, derived: Callable[[DataFrame], dict[str, DataFrame]] | None = None, **more: DataFrame) -> None:
        """Many whole documents at once, visible together after one commit.

        documents: doc_id, name, path; chunks: all of their chunks, embedded.
        Nothing is gathered on the driver.  ``more`` adds other tables
        (concepts, edges, topics), each with doc_id, as do those that
        ``derived`` makes of the chunks as written.  Known ids are an error,
        or are replaced in every table if ``update``.  ``batch`` names a stream
        and its batch: one that the index has taken already changes nothing.
        """
        done = lambda now: batch is not None and now["streams"].get(batch[0], -1) >= batch[1]
        if done(self.manifest()):
            return
        parts, size, totals = self._chunk_parts(chunks, with_links)
        listed = saved(self._with_totals(documents, totals), "documents")
        more |= derived(self._part("chunks", parts["chunks"], chunks)) if derived else {}
        for name, rows in ({"documents": listed} | more).items():
            parts[name] = self._write(rows, name)

        def added(now: dict) -> dict | None:
            if done(now):
                return None
            known = listed.select("doc_id").join(self._ids(now), "doc_id", "left_semi")
            if not update and known.take(1):
                raise StorageError("a document is in the index already")
            old = known.take(1) if update else []
            if size is not None and now.get("dimension") not in (None, size):
                raise StorageError("vectors must be there, finite and of one dimension")
            now |= {"dimension": size or now.get("dimension")}
            now["streams"] |= {batch[0]: batch[1]} if batch else {}
            return self._listed(now, parts, self._removed(known) if old else None)

        self._commit(added)

    def _removed(self, ids: DataFrame, table: str | None = None) -> str:
        return self._write(ids.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(table).cast("string").alias("of")).distinct(), "removed")

    def remove(self, ids: DataFrame) -> None:
        """Takes the documents (doc_id) out of every table; unknown ids change nothing."""
        self._commit(lambda now: self._listed(now, {}, self._removed(ids)))

    def replace_graph(self, edges: DataFrame) -> None:
        """The whole concept graph anew: source, target, weight; loops and weights below 1 are left out.

        Its edges belong to no document; documents that come later add theirs.
        """
        rows = edges.filter("source <> target and weight > 0").select("source", "target", F.col("weight").cast("long").alias("weight"), F.lit(None).cast("string").alias("doc_id"))
        part = self._write(rows, "edges")

        def replaced(now: dict) -> dict:
            now["tables"]["edges"] = [[part, now["version"]]]
            return now

        self._commit(replaced)

    def replace_topics(self, topics: DataFrame, documents: DataFrame | None = None) -> None:
        """The topics of the given documents (by default those that ``topics`` has) anew; a document without any is left with none."""
        part, gone = self._write(topics, "topics"), self._removed(topics if documents is None else documents, "topics")
        self._commit(lambda now: self._listed(now, {"topics": part}, gone))

    def compact(self) -> None:
        """Every table as one part without hidden rows.  An index that changes meanwhile is left as it is, with an error."""
        was = self.manifest()
        parts = {name: self._write(rows, name) for name in TABLES if (rows := self._visible(name, was)) is not None}

        def compacted(now: dict) -> dict:
            if now["version"] != was["version"] + 1:
                raise StorageError("the index has changed meanwhile")
            return self._listed(now | {"tables": {t: [] for t in TABLES}, "removed": []}, parts)

        self._commit(compacted)

    # -- building in steps

    def prepare(self, documents: DataFrame, parsed: DataFrame) -> None:
        """Save all parsed chunks before anything is embedded.

        documents: doc_id, name, path.  A document prepared before must come
        with the same chunks; any difference is an error.
        """
        parsed, listed = saved(parsed, "parsed"), saved(documents.select("doc_id", "name", "path"), "documents")

        def prepared(now: dict) -> dict | None:
            known, old = self._ids(now), self._visible("parsed", now)
            if old is not None:
                both = broadcast_if_small(listed.join(known, "doc_id", "left_semi").select("doc_id"), 1_000_000)
                digest = F.sha2(F.to_json(F.struct(*parsed.columns)), 256).alias("digest")  # of whole rows, which are compared without their texts
                before, again = (rows.join(both, "doc_id", "left_semi").select("doc_id", digest) for rows in (old, parsed))
                if again.exceptAll(before).take(1) or before.join(again.select("doc_id").distinct(), "doc_id", "left_semi").exceptAll(again).take(1):
                    raise StorageError("a prepared document has changed")
            new = listed.join(known, "doc_id", "left_anti")
            if not new.take(1):
                return None
            sizes = parsed.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("total_chunks"))
            rows = new.join(sizes, "doc_id", "left").withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
            return self._listed(now, {"parsed": self._write(parsed.join(new, "doc_id", "left_semi"), "parsed"), "prepared": self._write(rows, "prepared")})

        self._commit(prepared)

    def _pending(self, now: dict) -> DataFrame | None:
        """Prepared documents that are not complete."""
        rows, done = self._visible("prepared", now), self._visible("documents", now)
        return rows if rows is None or done is None else rows.join(done.select("doc_id"), "doc_id", "left_anti")

    def write_batch(self, doc_id: str, chunks: DataFrame, start: int, end: int) -> None:
        """Chunks start..end-1 of a prepared document, with embeddings.

        Must follow on progress, or lie wholly before it (a replay, which
        changes nothing).  The last batch adds links and completes the document.
        """
        found = self.documents().filter(F.col("doc_id") == doc_id).take(1)
        if not found:
            raise StorageError(f"{doc_id} was not prepared")
        done, total = found[0].processed_chunks, found[0].total_chunks
        if found[0].state == "complete" or end <= done and end > start:
            return
        if start != done or end > total:
            raise StorageError(f"batch {start}..{end} does not follow on {done} of {total}")
        if chunks.count() != end - start:
            raise StorageError(f"batch {start}..{end} has another number of chunks")
        parts, size, _ = self._chunk_parts(chunks, with_links=False)
        if end == total:
            now = self.manifest()
            own = lambda rows: rows.filter(F.col("doc_id") == doc_id)
            parts["links"] = self._write(build_links(own(self._visible("parsed", now))), "links")
            held = self._visible("postings", now)
            last = self._terms(parts)
            terms = own(last if held is None else held.select("doc_id", "tf").unionByName(last)).groupBy("doc_id").agg(F.sum("tf").alias("total_terms"))
            totals = own(self._visible("prepared", now)).select("doc_id", "total_chunks").join(terms, "doc_id", "left")
            parts["documents"] = self._write(self._with_totals(own(self._visible("prepared", now)), totals), "documents")

        def written(now: dict) -> dict:
            held = self._visible("chunks", now)
            if held is not None and held.filter(F.col("doc_id") == doc_id).count() != done:
                raise StorageError(f"{doc_id} has changed meanwhile")
            return self._listed(now | {"dimension": size or now.get("dimension")}, parts)

        self._commit(written)

    def resume(self, embed: Callable[[Column], Column], chunks_at_once: int = 1_000_000) -> DataFrame:
        """Embeds what prepared documents still lack and completes them; their ids.

        Documents are dealt by a hash into waves of about ``chunks_at_once``
        chunks, of more where those would be over MOST_WAVES waves; a wave is
        one commit, so an interrupted call loses one wave at most and the next
        call goes on after it.
        """
        now = self.manifest()
        found = self._pending(now)
        ids = None if found is None else saved(found, "pending")
        if ids is None or not ids.take(1):
            return self.spark.createDataFrame([], "doc_id string")
        lack = ids.agg(F.sum("total_chunks")).first()[0]
        waves = min(MOST_WAVES, max(1, -(-lack // max(1, chunks_at_once))))
        wave = F.pmod(F.xxhash64("doc_id"), F.lit(waves)).cast("int")
        rows, begun = self._lacking(now, ids)
        # Dealt out once, so that a wave reads its own rows only.
        dealt = rows if waves == 1 else saved(rows.withColumn("wave", wave), "waves", by="wave")
        for i in range(waves):
            newest = self.manifest()
            if dealt is not None and newest["version"] == now["version"]:
                docs, mine = (ids, dealt) if waves == 1 else (ids.filter(wave == i), dealt.filter(F.col("wave") == i).drop("wave"))
            else:  # another writer came in between, so the wave is looked up anew
                dealt, now = None, newest
                docs = saved(self._pending(now).filter(wave == i), "wave")
                mine, begun = self._lacking(now, docs)
            if docs.take(1):
                done = Wave(now, docs, mine, begun)
                self._wave(embed, done)
                now = done.now
        return ids.select("doc_id")

    def _lacking(self, now: dict, docs: DataFrame) -> tuple[DataFrame, bool]:
        """The parsed chunks of pending documents, each with whether it is ``held`` already; and whether any is."""
        ids = broadcast_if_small(docs.select("doc_id"), 1_000_000)
        parsed, chunks = self._visible("parsed", now), self._visible("chunks", now)
        rows = parsed.join(ids, "doc_id", "left_semi").select(*parsed.columns)
        held = None if chunks is None else saved(chunks.join(ids, "doc_id", "left_semi").select("chunk_id"), "held")
        if held is None or not held.take(1):
            return rows.withColumn("held", F.lit(False)), False
        return rows.join(held.withColumn("held", F.lit(True)), "chunk_id", "left").select(*parsed.columns, F.coalesce("held", F.lit(False)).alias("held")), True

    def _wave(self, embed: Callable[[Column], Column], mine: Wave) -> None:
        """Completes the wave's documents, and leaves in it the manifest that shows them."""
        now, docs, rows, begun = mine.now, mine.docs, mine.rows, mine.begun
        parts, size, _ = self._chunk_parts(rows.filter("not held").drop("held").withColumn("embedding", embed(F.col("clean_text"))), with_links=False)
        parts["links"] = self._write(build_links(rows.drop("held")), "links")
        last = self._terms(parts)
        before = self._visible("postings", now) if begun else None
        terms = last if before is None else before.select("doc_id", "tf").join(docs.select("doc_id"), "doc_id", "left_semi").unionByName(last)
        totals = docs.select("doc_id", "total_chunks").join(terms.groupBy("doc_id").agg(F.sum("tf").alias("total_terms")), "doc_id", "left")
        parts["documents"] = self._write(self._with_totals(docs, totals), "documents")

        def completed(new: dict) -> dict | None:
            if new["version"] != now["version"] + 1 and docs.join(self._visible("documents", new) or docs.limit(0), "doc_id", "left_semi").take(1):
                raise StorageError("a prepared document was completed meanwhile")
            return self._listed(new | {"dimension": size or new.get("dimension")}, parts)

        mine.now = self._commit(completed)

    # -- reading

    def _visible(self, name: str, now: dict) -> DataFrame | None:
        """A table's rows that no later removal hides; newer parts are read without a join."""
        parts = now["tables"].get(name) or []
        if not parts:
            return None
        latest = max((v for _, v in now["removed"]), default=0)
        fresh, old = ([p for p, v in parts if (v >= latest) == side] for side in (True, False))
        rows = self._read(fresh, now).drop("part") if fresh else None
        if old:
            numbers = F.broadcast(self.spark.createDataFrame([(p.partition("=")[2], v) for p, v in parts + now["removed"]], "part string, _version long"))  # one row a part
            gone = self._read([p for p, _ in now["removed"]], now).filter(F.col("of").isNull() | (F.col("of") == name)).join(numbers, "part")
            gone = broadcast_if_small(gone.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("_version").alias("_before")), 1_000_000)
            held = self._read(old, now).join(numbers, "part")
            held = held.join(gone, (F.col("doc_id").cast("string") == F.col("_gone")) & (F.col("_version") < F.col("_before")), "left_anti").drop("part", "_version")
            rows = held if rows is None else rows.unionByName(held)
        return rows

    def _ids(self, now: dict) -> DataFrame:
        """The ids of complete and of prepared documents."""
        found = [rows.select(F.col("doc_id")) for t in ("documents", "prepared") if (rows := self._visible(t, now)) is not None]
        return found[0].unionByName(found[1]) if len(found) == 2 else found[0] if found else self.spark.createDataFrame([], "doc_id string")

    def table(self, name: str) -> DataFrame | None:
        """A table as it stands; weights of an edge that several documents or ingests counted are summed."""
        rows = self._visible(name, self.manifest())
        return rows.groupBy("source", "target").agg(F.sum("weight").alias("weight")) if name == "edges" and rows is not None else rows

    def documents(self) -> DataFrame:
        """doc_id, name, path, processed_chunks, state (building or complete) and total_chunks."""
        now = self.manifest()
        done, pending = self._visible("documents", now), self._pending(now)
        columns = ["doc_id", "name", "path", "processed_chunks", "state", "total_chunks"]
        out = None if done is None else done.withColumns({"processed_chunks": F.col("total_chunks"), "state": F.lit("complete")}).select(*columns)
        if pending is not None:
            chunks = self._visible("chunks", now)
            if chunks is not None:
                pending = pending.join(chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("processed_chunks")), "doc_id", "left")
            else:
                pending = pending.withColumn("processed_chunks", F.lit(None).cast("int"))
            pending = pending.withColumns({"processed_chunks": F.coalesce("processed_chunks", F.lit(0)), "state": F.lit("building")}).select(*columns)
            out = pending if out is None else out.unionByName(pending)
        return out if out is not None else self.spark.createDataFrame([], "doc_id string, name string, path string, processed_chunks int, state string, total_chunks int")

    def complete(self, name: str) -> DataFrame:
        """A table's rows of complete documents."""
        now = self.manifest()
        rows = self._visible(name, now)
        if rows is None:
            raise StorageError(f"the index has no {name}")
        if not now["tables"]["prepared"]:
            return rows
        done = self._visible("documents", now)
        return rows.limit(0) if done is None else rows.join(done.select("doc_id"), "doc_id", "left_semi")

    def chunks(self, ids: DataFrame | None = None, scope: str | None = None, with_concepts: bool = False) -> DataFrame:
        """Chunks of complete documents: all, those of the given chunk_ids, those of one document; with their concepts in order if asked."""
        rows = self.complete("chunks")
        if scope is not None:
            rows = rows.filter(F.col("doc_id") == self.resolve_scope(scope))
        if ids is not None:
            rows = rows.join(broadcast_if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")
        if not with_concepts:
            return rows
        none, found = F.array().cast("array<string>"), self.table("concepts")
        if found is None:
            return rows.withColumn("concepts", none)
        if ids is not None:
            found = found.join(broadcast_if_small(ids.select("chunk_id").distinct()), "chunk_id", "left_semi")
        named = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "concept"))).alias("c")).select("chunk_id", F.col("c.concept").alias("concepts"))
        return rows.join(named, "chunk_id", "left").withColumn("concepts", F.coalesce("concepts", none))

    def postings_of(self, terms: DataFrame) -> DataFrame:
        """The postings in the buckets of the given terms; the driver sees at most BUCKETS numbers."""
        rows = self.table("postings")
        if rows is None:
            return self.spark.createDataFrame([], "term string, chunk_id string, tf long, dl int, doc_id string, bucket int")
        wanted = [r.b for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]
        return rows.filter(F.col("bucket").isin(wanted))

    def statistics(self) -> DataFrame:
        """One row: n chunks and their average length in terms, kept by document and summed."""
        now = self.manifest()
        rows = self._visible("documents", now)
        n, total = F.coalesce(F.sum("total_chunks"), F.lit(0)), F.coalesce(F.sum("total_terms"), F.lit(0))
        return rows.agg(n.alias("n"), F.when(n > 0, total / n).alias("avgdl"))

    def resolve_scope(self, scope: str | None) -> str | None:
        """A document by id, else by its one exact name or path."""
        if scope is None:
            return None
        asked = self.spark.createDataFrame([(scope,)], "scope string")
        return checked_scopes(scopes.resolve(asked, self.documents())).first().doc_id

    def capabilities(self) -> dict[str, bool]:
        """What the index can serve; reads the manifest and schemas only."""
        if not self.exists():
            return dict.fromkeys(("vector", "lexical", "evidence_ready", "graph", "topic"), False)
        now = self.manifest()["tables"]
        chunks = self.table("chunks")
        has = bool(chunks is not None and "embedding" in chunks.columns)
        return {"vector": has, "lexical": bool(now["postings"]), "evidence_ready": has and bool(now["documents"]), "graph": bool(now["edges"]), "topic": bool(now["topics"])}


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def checked_scopes(resolved: DataFrame) -> DataFrame:
    """What ``scopes.resolve`` gives; a scope that names no complete document is an error."""
    wrong = resolved.filter("outcome not in ('all', 'ok')").select("scope", "outcome", "doc_id").take(1)
    if wrong:
        said = f"{wrong[0].doc_id} is not complete" if wrong[0].outcome == "incomplete" else f"{wrong[0].outcome} scope: {wrong[0].scope}"
        raise ScopeError(said)
    return resolved
