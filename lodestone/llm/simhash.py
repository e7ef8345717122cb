"""SimHash near duplicates with pigeonring filtering.

A fingerprint's 64 bits are a ring of four segments of 16 bits.  If two
fingerprints differ in at most three bits, then some segment starts a chain
whose cumulative differences stay within the proportional budgets floor(l * 3
/ 4) for l = 1, 2, 3, 4 segments: 0, 1, 2 and 3 bits.  The first two links of
the chain (an equal segment, then one with at most one differing bit) are an
equi-join: every distinct fingerprint is indexed under its four pairs of
consecutive segments, and probes each pair with the 17 values that differ in
at most one bit of the second segment.  The third link is tested on what the
join finds, and only then the full Hamming distance.

The join runs over distinct fingerprints, so copies cost nothing.  A bucket
holds distinct fingerprints that agree on 32 bits; where it grows large, the
third link joins the key, so that no more than the 65,536 fingerprints that
agree on 48 bits can ever meet.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lodestone.llm.batches import map_texts
from lodestone.llm.common import Workspace
from lodestone.llm.components import components

SEED = 42
SHINGLE = 3
DISTANCE = 3
SEGMENTS = 4
SEGMENT_BITS = 64 // SEGMENTS
#: Fingerprints in a bucket from which its members are told apart by a further segment.
HOT_BUCKET = 2_000
#: Shingle hashes counted at once, for very long texts.
HASHES_AT_ONCE = 1 << 20


def shingle_hashes(text: str, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``width`` words, A-Z lower-cased, space-joined."""
    words = text.encode().lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    whole = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[: -width])]
    return [xxh64_intdigest(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(text: str, width: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the shingle hashes; zero for a text of no words."""
    hashes = shingle_hashes(text, width, seed)
    if not hashes:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[i : i + HASHES_AT_ONCE], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """id and fp (the 64 bits as a signed long) of every whole text."""

    def work(texts: list[str]) -> list[list]:
        return [np.array([fingerprint(t, width, seed) for t in texts], dtype=np.uint64).view(np.int64)]

    return map_texts(docs, id_col, text_col, {"fp": ("long", pa.int64())}, work)


def masks(most: int) -> list[int]:
    """Differences of at most ``most`` bits in a segment."""
    bits = [1 << b for b in range(SEGMENT_BITS)]
    return [sum(c) for n in range(most + 1) for c in combinations(bits, n)]


def _turned(x: str, by: str) -> str:
    """x as a ring, turned left by so many bits."""
    return f"(shiftleft({x}, {by}) | shiftrightunsigned({x}, 64 - {by}))"


def links(nodes: DataFrame, work: Workspace, hot: int = HOT_BUCKET) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) within the distance.

    A pair can come once for every chain that it has.  Buckets of more than
    ``hot`` fingerprints are joined on the chain's third link as well, whose
    allowed differences are enumerated too; what then meets agrees on 48 bits.
    """
    keys = ", ".join(f"shiftrightunsigned({_turned('fp', str(SEGMENT_BITS * i))}, 32) | {i << 32}L" for i in range(SEGMENTS))
    flips = ", ".join(f"{x}L" for x in masks(1))
    index = nodes.select(F.col("fp").alias("b"), F.expr(f"explode(array({keys}))").alias("key"))
    probe = nodes.select(F.col("fp").alias("a"), F.expr(f"explode(array({keys}))").alias("own"))
    probe = probe.select("a", F.expr(f"explode(transform(array({flips}), e -> own ^ e))").alias("key"))
    turn = f"cast(shiftrightunsigned(key, 32) * {SEGMENT_BITS} as int)"
    third = f"bit_count(shiftrightunsigned({_turned('(a ^ b)', turn)}, {SEGMENT_BITS})) <= 2"
    near = f"a < b and {third} and bit_count(a ^ b) <= {DISTANCE}"
    crowded = work.save(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key"), "crowded")
    if not crowded.take(1):
        return probe.join(index.hint("merge"), "key").filter(near).select("a", "b")
    calm = probe.join(index.join(crowded, "key", "left_anti").hint("merge"), "key").filter(near).select("a", "b")
    segment = lambda x: f"shiftrightunsigned({_turned(x, turn)}, {SEGMENT_BITS}) & {(1 << SEGMENT_BITS) - 1}"
    spread = ", ".join(f"{x}L" for x in masks(2))
    full_index = index.join(crowded, "key", "left_semi").withColumn("link", F.expr(segment("b")))
    full_probe = probe.join(crowded, "key", "left_semi")
    full_probe = full_probe.withColumn("link", F.expr(f"explode(transform(array({spread}), e -> ({segment('a')}) ^ e))"))
    full = full_probe.join(full_index.hint("merge"), ["key", "link"]).filter(near).select("a", "b")
    return calm.unionByName(full)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most three
    differing bits, the row's own id included.  Texts without words have
    fingerprint zero and link like any other; null text counts as empty.
    Null ids never become a component's id unless it has no other.  Repeated
    rows are each reported; extra columns are ignored.
    """
    work = Workspace(docs.sparkSession, "simhash")
    fps = work.save(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "fps")
    nodes = work.save(fps.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes, work), work)
    named = nodes.join(roots.hint("merge"), nodes.fp == roots.node, "left")
    named = work.save(named.select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    least = work.save(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    member = work.save(named.join(least.hint("merge"), "root").select("fp", "component_id"), "member")
    out = fps.join(member.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group: the one with the smallest id.

    Rows that tie on that id stay together.  All columns stay.
    """
    kept = near_duplicates(docs, id_col, text_col).filter(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept.hint("merge"), docs[id_col].eqNullSafe(kept["_kept"]), "left_semi")
