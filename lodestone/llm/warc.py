"""WARC archives as seekable Zstandard bundles.

Every page becomes a WARC record: a response with its payload, or a revisit
that names the response holding an equal payload.  A task writes its records
into bundles in the shared folder.  A bundle is a run of independent
Zstandard frames of about FRAME_BYTES of records each, closed by a seek table
in a skippable frame (the public seekable format), so that any record can be
had by reading the footer, one frame, and a slice of it.  The index maps each
record to bundle, frame, offset and length inside the frame.

Bundles carry a name of their own per task attempt and only those named in the
written index count, so tasks that are lost and run again leave no records
twice.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, whole_text

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
MOST_READ_TASKS = 20_000
#: Fixed values of the seekable format and of WARC.
SKIPPABLE, SEEKABLE, FOOTER_BYTES, MOST_FRAMES = 0x184D2A5E, 0x8F92EAB1, 9, 0x8000000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


NO_ID = "urn:page-without-id"


def name_of(page_id) -> str:
    """The record id of a page; one without an id shares NO_ID with the others."""
    return f"<{NO_ID}>" if page_id is None else f"<urn:page:{page_id}>"


def id_of(name: str | None) -> str | None:
    return None if name is None or name == f"<{NO_ID}>" else name.removeprefix("<urn:page:").removesuffix(">")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record; a revisit carries the HTTP head only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name_of(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes, start: int = 0) -> tuple[dict, int]:
    """The record at ``start`` (headers, http head, payload) and its end."""
    stop = raw.index(b"\r\n\r\n", start)
    version, *lines = raw[start:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    heads = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(heads["Content-Length"])
    if raw[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = raw[begin:end].partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    return {"heads": heads, "payload": payload, "size": size}, end + 4


class BundleWriter:
    """Appends records to one seekable bundle."""

    def __init__(self, sink):
        self.sink, self.frames, self.buffer, self.written = sink, [], io.BytesIO(), 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame and length of the record."""
        at = (len(self.frames), self.buffer.tell(), len(raw))
        self.buffer.write(raw)
        if self.buffer.tell() >= FRAME_BYTES:
            self._frame()
        return at

    def _frame(self) -> None:
        if len(self.frames) >= MOST_FRAMES:
            raise ValueError("a seek table holds no more frames")
        raw = self.buffer.getvalue()
        packed = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.written += len(raw)
        self.buffer = io.BytesIO()

    def close(self) -> None:
        if self.buffer.tell():
            self._frame()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class BundleReader:
    """Random access to the frames of a bundle, through its seek table."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != SEEKABLE or flags & 0x80:
            raise ValueError("no seek table that can be read")
        table = source.read_at(8 * count, size - FOOTER_BYTES - 8 * count)
        self.spans, at = [], 0
        for i in range(count):
            packed, raw = struct.unpack_from("<II", table, 8 * i)
            self.spans.append((at, packed, raw))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.spans[number]
        out = zstandard.ZstdDecompressor().decompress(self.source.read_at(packed, at), max_output_size=raw)
        if len(out) != raw:
            raise ValueError("a frame's length is wrong")
        return out

    def record(self, frame: int, offset: int, length: int) -> dict:
        return parse(self.frame(frame)[offset : offset + length])[0]


@lru_cache(maxsize=8)
def store(root: str):
    """File system and path of a folder given by URI (as Hadoop names it) or local path."""
    kind, colon, rest = root.partition("://")
    return pyarrow.fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(kind, kind) + colon + rest)


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records; the index: page_id, digest, revisit, bundle, frame, offset, length.

    ``pages``: page_id, url, payload (binary), digest (SHA-1 in hex), refers_to
    and revisit.  The result must be written before use: it writes as it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        fs.create_dir(path, recursive=True)
        writer, name = None, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.warc.zst"
                        writer = BundleWriter(fs.open_output_stream(f"{path}/{name}", compression=None))
                    rows.append((name, *writer.add(record(page_id, url, payload, base32(digest), refers_to, revisit))))
                    if writer.written >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
                names, frames, offsets, lengths = zip(*rows, strict=True) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(5), pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in (frames, offsets, lengths))], names=["page_id", "digest", "revisit", "bundle", "frame", "offset", "length"])
        finally:
            if writer is not None:
                writer.close()

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, f"page_id {kind}, digest string, revisit boolean, bundle string, frame long, offset long, length long")


def read_bundles(bundles: DataFrame, folder: str, kind: str | None = None) -> DataFrame:
    """Every record of the named bundles, or those of a kind (response, revisit), frame by frame, digests checked.

    Columns: page_id and refers_to (strings), payload (null for a revisit),
    payload_bytes, payload_digest, record_type, url.
    """
    out = pa.schema([("page_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("url", pa.string())])

    def fields(found: dict) -> tuple:
        heads, payload = found["heads"], found["payload"]
        digest = heads["WARC-Payload-Digest"].removeprefix("sha1:")
        whole = heads["WARC-Type"] == "response"
        if whole and (base32(hashlib.sha1(payload).hexdigest()) != digest or len(payload) != found["size"]):
            raise ValueError(f"the payload of {heads['WARC-Record-ID']} is not what was written")
        named = lambda key: id_of(heads.get(key))
        return named("WARC-Record-ID"), payload if whole else None, found["size"], digest, heads["WARC-Type"], named("WARC-Refers-To"), heads["WARC-Target-URI"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    reader = BundleReader(source)
                    for number in range(len(reader.spans)):
                        raw, at, rows = reader.frame(number), 0, []
                        while at < len(raw):
                            found, at = parse(raw, at)
                            if kind in (None, found["heads"]["WARC-Type"]):
                                rows.append(fields(found))
                        if not rows:
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return bundles.select("bundle").mapInArrow(run, "page_id string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string, url string")


def fetch(index_rows: list, folder: str) -> list[dict]:
    """Records by their index rows (bundle, frame, offset, length): random access."""
    fs, path = store(folder)
    out = []
    for row in index_rows:
        with fs.open_input_file(f"{path}/{row['bundle']}") as source:
            out.append(BundleReader(source).record(row["frame"], row["offset"], row["length"]))
    return out


def read_targets(spots: DataFrame, folder: str) -> DataFrame:
    """target (page id as a string), target_bytes and target_digest of the records at the index rows ``spots``.

    Random access: a bundle's seek table and the frames that hold them are
    read, each once, and digests checked; rows come sorted by bundle and frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store(folder)
        now = reader = source = raw = None
        try:
            for batch in batches:
                rows = []
                for bundle, frame, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is None or now[0] != bundle:
                        if source is not None:
                            source.close()
                        source = fs.open_input_file(f"{path}/{bundle}")
                        reader, now = BundleReader(source), (bundle, None)
                    if now[1] != frame:
                        raw, now = reader.frame(frame), (bundle, frame)
                    found = parse(raw[offset : offset + length])[0]
                    digest = base32(hashlib.sha1(found["payload"]).hexdigest())
                    if f"sha1:{digest}" != found["heads"]["WARC-Payload-Digest"]:
                        raise ValueError("a payload is not what was written")
                    rows.append((id_of(found["heads"]["WARC-Record-ID"]), len(found["payload"]), digest))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["target", "target_bytes", "target_digest"])
        finally:
            if source is not None:
                source.close()

    sorted_spots = spots.select("bundle", "frame", "offset", "length").repartition("bundle").sortWithinPartitions("bundle", "frame", "offset")
    return sorted_spots.mapInArrow(run, "target string, target_bytes long, target_digest string")


def archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame, str]:
    """Archives pages; (index, records read back, folder of the bundles).

    Of pages with equal payloads of at least ``least_bytes`` bytes the one
    with the smallest id is the response; the others revisit it.  Null html is
    an empty payload.  Rows that tie on payload and smallest id are all
    responses; null ids compare as larger than any other, and a payload held
    by null ids only is a response each time.  Extra columns are ignored.
    Payloads are equal by SHA-1 and length, as the format has it.  What a
    revisit says of its payload is read from the record it refers to, which the
    index finds by id and digest; a revisit without such a record is an error.
    """
    work = Workspace(pages.sparkSession, "warc")
    payload = whole_text(html_col).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.length(payload).alias("size"))
    first = rows.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    first = work.save(first.filter(f"n > 1 and size >= {least_bytes}").drop("n"), "first")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first.hint("merge"), ["digest", "size"], "left")
    rows = rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    folder = work.path("bundles")
    index = work.save(write_bundles(rows, folder), "index")
    bundles = work.save(index.select("bundle").distinct(), "names")
    # One task a bundle: the names alone are too small for the engine to see the work behind them.
    tasks = max(1, min(bundles.count(), MOST_READ_TASKS))
    # A revisit's target is the response of that id with that payload: ids may repeat.
    named = first.select(F.col("first").alias("page_id"), "digest").filter("page_id is not null").distinct()
    spots = index.filter("not revisit").join(named.hint("merge"), ["page_id", "digest"]).groupBy("page_id", "digest").agg(F.min(F.struct("bundle", "frame", "offset", "length")).alias("at")).select("at.*")
    targets = work.save(read_targets(spots, folder), "targets")
    # Responses take no part in the join: only revisits, which carry no payload, are shuffled.
    own = bundles.repartition(tasks)
    responses, revisits = read_bundles(own, folder, "response"), read_bundles(own, folder, "revisit")
    found = revisits.join(targets.hint("merge"), (revisits.refers_to == targets.target) & (revisits.payload_digest == targets.target_digest), "left")
    size = F.coalesce("target_bytes", F.raise_error(F.concat(F.lit("no response for the revisit "), F.coalesce(F.col("page_id"), F.lit(NO_ID)))).cast("long"))
    columns = ["page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    records = responses.select(*columns).unionByName(found.select("page_id", "payload", size.alias("payload_bytes"), F.col("target_digest").alias("payload_digest"), "record_type", "refers_to", "url"))
    return index, records, folder
