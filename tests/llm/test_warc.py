import base64
import hashlib
import io
import random

import pyarrow as pa
import pytest

from lodestone.llm import queries, warc


def plain(rows):
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        first = min(same) if same else None
        revisit = first is not None and i != first
        out.append((None if i is None else str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", str(first) if revisit else None))
    return sorted(out, key=str)


def read(records):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records.collect()), key=str)


def test_archive_round_trip_and_random_access(spark):
    rng = random.Random(6)
    bodies = ["", "<p>é</p>", "\r\n\r\nWARC/1.1\r\n", "x" * 3000000] + ["".join(rng.choice("ab\r\n") for _ in range(200)) for _ in range(40)]
    rows = [(i, f"http://e.org/{i}", bodies[i % len(bodies)] if i % 3 else bodies[1]) for i in range(150)] + [(200, None, None), (None, "u", "only"), (7, "again", bodies[7])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    index, records, folder = warc.archive(df)
    assert read(records) == plain(rows)
    want = {i: (h or "").encode() for i, _, h in rows}
    for found, row in zip(warc.fetch(spots := [r.asDict() for r in index.collect()], folder), spots, strict=True):
        if found["heads"]["WARC-Type"] == "response":
            assert found["payload"] == want[row["page_id"]]


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    _, records, _ = warc.archive(df, least_bytes=3)
    assert {(r.page_id, r.record_type) for r in records.collect()} == {("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")}


def test_targets_of_repeated_ids_with_unlike_payloads(spark):
    rows = [(1, "u", "aaa"), (1, "u", "bbbbb"), (2, "u", "bbbbb"), (3, "u", "aaa"), (1, "v", "bbbbb")]
    _, records, _ = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert read(records) == plain(rows)


def test_payload_on_a_third_of_all_pages(spark):
    rows = [(i, "u", "common" if i % 3 == 0 else f"own {i}" if i % 3 == 1 else f"pair {i // 6}") for i in range(3_000)]
    _, records, _ = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7))
    assert read(records) == plain(rows)


def test_null_ids_through_the_query(spark, tmp_path):
    rows = [(None, "u", "same"), (None, "u", "same"), (4, "u", "same"), (3, "u", "same"), (None, None, "alone")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in queries.op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(3, "response", None, 4), (4, "revisit", 3, 4), (None, "revisit", 3, 4), (None, "revisit", 3, 4), (None, "response", None, 5)], key=str)


def test_store_takes_hadoop_names():
    kind, path = warc.store("s3a://bucket/folder?region=none")
    assert path == "bucket/folder" and kind.type_name == "s3"


def test_empty_table(spark):
    index, records, _ = warc.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.collect() == [] and records.collect() == []


def test_frames_are_independent_and_damage_is_noticed():
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.BundleWriter(out)
    spots = [writer.add(warc.record(n, "u", bytes([65 + n]) * 600_000, "D" * 32)) for n in range(5)]
    writer.close()
    raw = out.getvalue()
    reader = warc.BundleReader(pa.BufferReader(raw))
    assert len(reader.spans) > 1
    assert reader.record(*spots[4])["payload"] == b"E" * 600_000
    with pytest.raises(ValueError):
        warc.BundleReader(pa.BufferReader(raw[:-1] + b"\x00"))
