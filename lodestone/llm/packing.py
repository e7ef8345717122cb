"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document is its ids and a closing id.  Every whole sequence's worth of it is
a sequence of its own; what is left is cut into grains of a few score ids.  A
task collects grains until they fill GROUP sequences but for a little slack,
then deals them out: each grain starts as a partial partition of k windows
with one of them loaded; the two partitions with the largest differences
between their windows are merged, the fullest windows of one on the emptiest
of the other, until one partition is left, whose windows are nearly equal.
Where the fullest still passes the capacity, k rises by one and the group is
dealt out anew.  The last, smaller group of a task leaves a remainder of less
than a sequence, which goes to sequences of powers of two: those are not
padded.

Nothing is shuffled: a task packs the rows it reads, holding one group and one
slice of texts.  Sequence ids carry the partition's number, so a task that is
run again on the same rows writes the same sequences.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestone.llm.batches import bound_batches, row_slices

#: Sequences of a group, ids of a grain at most, and ids by which the mean window stays below the capacity, all for 1,024.
GROUP, GRAIN, SLACK = 64, 128, 8
#: Sequence ids of one partition.
ID_BITS = 40
#: Characters of text encoded at once.
CHARS_AT_ONCE = 1_000_000
#: Fixed value: the pattern that byte-level pre-tokenization applies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each of the sizes."""
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    loads = dict(enumerate(np.zeros((n, k), dtype=np.int64)))  # of each partial partition, falling, the least taken off
    for i, size in enumerate(sizes):
        loads[i][0] = size if k > 1 else 0
    heap = [(-int(x[0]), i) for i, x in loads.items()]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        loads[n + len(merges)] = both - both[-1]
        heapq.heappush(heap, (int(both[-1] - both[0]), n + len(merges)))
        merges.append((a, b, order))
    # Back down: which window each place of a merged partition has become.
    window, places = np.zeros(n, dtype=np.int64), {heap[0][1]: np.arange(k)}
    for i in range(n + len(merges) - 1, -1, -1):
        now = places.pop(i)
        if i < n:
            window[i] = now[0]
            continue
        a, b, order = merges[i - n]
        before = np.empty(k, dtype=np.int64)
        before[order] = now
        places[a], places[b] = before, before[::-1]
    return window


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each of the sizes (none over the capacity), as few windows as differencing keeps within it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = difference(sizes, k)
        if np.bincount(found, sizes, minlength=k).max() <= capacity:
            return found
        k += 1


class Packer:
    """Packs documents as they come; ``rows`` gathers the pieces of finished sequences.

    A piece: (document, start, ids, the document's ids in all, sequence, offset).
    """

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.grain, self.room = max(1, capacity * GRAIN // 1024), max(1, capacity - capacity * SLACK // 1024)
        self.rows: list[tuple] = []
        self.held: list[tuple] = []  # (document, start, ids, total)
        self.size = 0

    def add(self, doc, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.capacity:
            self._lay([(doc, start, ids[start : start + self.capacity], total)])
            start += self.capacity
        while start < total:
            end = min(total, start + self.grain, start + GROUP * self.room - self.size)
            self.held.append((doc, start, ids[start:end], total))
            self.size += end - start
            start = end
            if self.size == GROUP * self.room:
                self._deal(self.held)
                self.held, self.size = [], 0

    def finish(self) -> None:
        """Deals out what is left; the remainder goes to sequences of powers of two."""
        rest = self.size % self.room
        whole, over = self.held, []
        while rest:
            doc, start, ids, total = whole.pop()
            cut = max(0, len(ids) - rest)
            if cut:
                whole.append((doc, start, ids[:cut], total))
            over.append((doc, start + cut, ids[cut:], total))
            rest -= len(ids) - cut
        if whole:
            self._deal(whole)
        size, now, over = sum(len(x[2]) for x in over), [], over[::-1]
        while size:
            left = power = 1 << (size.bit_length() - 1)
            while left:
                doc, start, ids, total = over.pop(0)
                if len(ids) > left:
                    over.insert(0, (doc, start + left, ids[left:], total))
                now.append((doc, start, ids[:left], total))
                left -= len(now[-1][2])
            self._lay(now)
            size, now = size - power, []
        self.held, self.size = [], 0

    def _deal(self, pieces: list[tuple]) -> None:
        found = windows([len(p[2]) for p in pieces], self.capacity)
        order = np.argsort(found, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(found[order])) + 1):
            self._lay([pieces[i] for i in part])

    def _lay(self, pieces: list[tuple]) -> None:
        """One sequence; pieces of a document that follow on one another become one."""
        offset, now = 0, None
        for doc, start, ids, total in pieces:
            if now is not None and now[0] is doc and now[1] + len(now[2]) == start:
                now[2] = np.concatenate((now[2], ids))
            else:
                now = [doc, start, ids, total, self.next, offset]
                self.rows.append(now)
            offset += len(ids)
        self.next += 1


class Encoder:
    """Ids as ``tokenizers`` gives them for a byte-level BPE file, without added special tokens.

    Where the file is plain byte-level BPE whose merges rank as their ids do,
    tiktoken holds the same table and does the work; the strings of the file's
    special tokens are taken as those tokens either way.  Texts that it gives
    up on (very long blanks) and all other files go to ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core, and was forked
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.fast = self._fast(json.load(file))

    @staticmethod
    def _fast(found: dict):
        model, cut, added = found["model"], found.get("pre_tokenizer") or {}, found.get("added_tokens") or []
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain &= cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not found.get("normalizer")
        plain &= not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added)
        if not plain:
            return None
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {a["content"]: a["id"] for a in added}
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        if not byte_of.keys() <= vocab.keys():
            return None
        if any(vocab.get(t) != 256 + i for i, t in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items()}, special_tokens=special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all")
            except ValueError:
                pass
        return self.own.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked.

    ``path`` is a ``tokenizers`` file; each text's ids are followed by
    ``end_id``.  A null or empty text is that one id.  Every id of every row
    lies in exactly one piece; repeated rows and null ids are documents like
    any other (their pieces are told apart by what they hold, not by id).
    Extra columns are ignored; no rows give no pieces.  Sequences hold at most
    ``capacity`` ids, laid without gaps from offset 0.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, kind = load(path), Packer(capacity, TaskContext.get().partitionId() << ID_BITS), None

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            raw = [r[2].astype("<u4") for r in rows]
            longs = ([r[1] for r in rows], [len(x) for x in raw], [zlib.crc32(x.tobytes()) for x in raw], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows])
            arrays = [pa.array([r[0][0] for r in rows], kind), *(pa.array(x, pa.int64()) for x in longs)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([x.astype(np.int32) for x in raw], pa.list_(pa.int32()))] * with_ids, names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part, texts in row_slices(batch, 1, CHARS_AT_ONCE):
                for doc, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    packer.add((doc,), np.array([*encode(text), end_id], dtype=np.uint32))
                yield out()
        if kind is not None:
            packer.finish()
            yield out()

    columns = ", ".join(f"`{n}` long" for n in names[1:7])
    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"`id` {id_type}, {columns}" + ", `ids` array<int>" * with_ids)
    return found.withColumnRenamed("id", id_col)
