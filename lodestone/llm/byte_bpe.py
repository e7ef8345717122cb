"""Byte-level BPE encoding and decoding with DuckDB recursive queries.

Every Python worker keeps an in-process DuckDB with the merge table (left id,
right id -> merged id, which is also the rank).  The distinct pre-tokens of a
slice of texts become token-position rows (word, position, symbol, bytes); one
recursive query joins neighbouring positions with the merge table, picks each
word's leftmost pair of least rank, contracts it, and repeats until no word
has a pair left.  Decoding joins the token rows of a slice's distinct sequences
with the vocabulary and puts their bytes together by an ordered aggregation.

Long words are first cut wherever no token of the vocabulary reaches across,
which no contraction can either.  Parts that are still long go through a
recursion keyed by word and position, so that only the last state of each row
is kept.  There, where a word holds its least pair several times, all of them
are contracted in one step if that is the same as one by one: if no token that
the merged one would make with a neighbour ranks before it, nothing can come
in between.

Memory is bounded by the slice, by the rows given to one query, and by the
bytes in the caches of words and runs.  DuckDB never writes to a disk, so a
part without any cut that has more bytes than MOST_QUERIED would not fit its
memory: it runs to the same fixpoint step by step over arrays, which hold only
the live symbols, at about 40 bytes for each byte of the part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.batches import RecentCache, map_texts, slices
from lodestone.llm.cuts import Vocabulary

#: Bytes that either generation of the words, and of the decoded runs, of a worker's cache takes, and what an entry takes besides its text.
CACHED_BYTES, CACHED_RUN_BYTES, ENTRY_BYTES = 100_000_000, 20_000_000, 200
#: Tokens of a run that is decoded as one, and of the runs that one query takes.
RUN_TOKENS, TOKENS_AT_ONCE = 65_536, 1_000_000
#: Characters of text encoded at once: their words, as Python strings, take some twelve times as many bytes.
CHARS_AT_ONCE = 1_000_000
#: Words of more bytes are cut where no token reaches across.
LONG = 32
#: Characters for which only the regex module knows the pattern's classes.
BEYOND_LATIN = re.compile(r"[^\t-\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
#: Token-position rows held by one recursive query, of words alike in length.
ROWS_AT_ONCE = 600_000
#: Bytes of an uncut part that a query takes at most, and symbols that are looked up together beyond that.
MOST_QUERIED, SYMBOLS_AT_ONCE = 500_000, 1_000_000
NO_RANK = np.iinfo(np.int32).max

#: One pair of each word a step; every step's rows stay until the end, half a word's length squared for each word.
CONTRACT = """
WITH RECURSIVE step(w, p, s, t) AS (
    SELECT w, p, s, 0 FROM start
    UNION ALL
    (WITH pair AS (
        SELECT a.w, (m.rank::BIGINT << 32) | a.p AS k
        FROM step a JOIN step b ON a.w = b.w AND b.p = a.p + 1
        JOIN merges m ON m.ab = (a.s::BIGINT << 32) | b.s),
     best AS (
        SELECT w, (min(k) & 4294967295)::INTEGER AS p, (min(k) >> 32)::INTEGER AS made FROM pair GROUP BY w)
     SELECT step.w,
            step.p - (step.p > best.p)::INTEGER,
            CASE WHEN step.p = best.p THEN best.made ELSE step.s END,
            step.t + 1
     FROM step JOIN best ON step.w = best.w
     WHERE step.p <> best.p + 1)
),
settled AS (SELECT w, max(t) AS t FROM step GROUP BY w)
SELECT w, p, s FROM step JOIN settled USING (w, t)
"""

#: All pairs of least rank of each word a step where that is the same; only the last state is kept.
CONTRACT_LONG = """
WITH RECURSIVE step(w, p, s, l) USING KEY (w, p) AS (
    SELECT w, p, s, 1 FROM start
    UNION ALL
    (WITH live AS (SELECT w, p, s, l FROM step WHERE s >= 0),
     pair AS (
        SELECT a.w, a.p, b.p AS q, a.l + b.l AS l, m.rank, m.safe
        FROM live a JOIN live b ON b.w = a.w AND b.p = a.p + a.l
        JOIN merges m ON m.ab = (a.s::BIGINT << 32) | b.s),
     low AS (SELECT w, min(rank) AS rank FROM pair GROUP BY w),
     hit AS (
        SELECT pair.*, count(*) OVER (PARTITION BY pair.w) AS n
        FROM pair JOIN low ON low.w = pair.w AND low.rank = pair.rank),
     many AS (
        SELECT w, p, q, l, rank, safe, lag(q) OVER (PARTITION BY w ORDER BY p) IS DISTINCT FROM p AS fresh, row_number() OVER (PARTITION BY w ORDER BY p) AS nth
        FROM hit WHERE n > 1),
     doubt AS (SELECT w, p, l, rank FROM many WHERE NOT safe),
     first AS (
        SELECT d.w FROM doubt d JOIN live x ON x.w = d.w AND x.p = d.p + d.l JOIN merges m ON m.ab = (d.rank::BIGINT << 32) | x.s WHERE m.rank < d.rank
        UNION ALL
        SELECT d.w FROM doubt d JOIN live x ON x.w = d.w AND x.p + x.l = d.p JOIN merges m ON m.ab = (x.s::BIGINT << 32) | d.rank WHERE m.rank < d.rank
        UNION ALL
        SELECT d.w FROM doubt d JOIN merges m ON m.ab = (d.rank::BIGINT << 32) | d.rank WHERE m.rank < d.rank),
     chain AS (SELECT *, sum(fresh::INTEGER) OVER (PARTITION BY w ORDER BY p) AS island, w IN (SELECT w FROM first) AS single FROM many),
     best AS (
        SELECT w, p, q, l, rank FROM hit WHERE n = 1
        UNION ALL
        SELECT w, p, q, l, rank FROM chain
        QUALIFY CASE WHEN single THEN nth = 1 ELSE row_number() OVER (PARTITION BY w, island ORDER BY p) % 2 = 1 END)
     SELECT live.w, live.p,
            CASE WHEN kept.p IS NOT NULL THEN kept.rank WHEN gone.q IS NOT NULL THEN -1 ELSE live.s END,
            CASE WHEN kept.p IS NOT NULL THEN kept.l ELSE live.l END
     FROM live JOIN low ON low.w = live.w
     LEFT JOIN best kept ON kept.w = live.w AND kept.p = live.p
     LEFT JOIN best gone ON gone.w = live.w AND gone.q = live.p)
)
SELECT w, p, s FROM step WHERE s >= 0
"""

DECODE = """
SELECT r, string_agg(v.bytes_hex, '' ORDER BY p) AS whole
FROM runs JOIN vocabulary v ON v.id = runs.s
GROUP BY r
"""


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        #: Within Latin letters and ASCII the standard library's classes say the same, and faster.
        self.latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        pairs = [(self.ranks[x[:k]], self.ranks[x[k:]], r) for x, r in self.ranks.items() for k in range(1, len(x)) if x[:k] in self.ranks and x[k:] in self.ranks]
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        size = max(self.ranks.values()) + 1
        self.known = np.zeros(size, dtype=bool)
        self.known[list(self.ranks.values())] = True
        #: Tokens that no other one built on them ranks before.
        safe = np.ones(size, dtype=bool)
        safe[[part for a, b, r in pairs for part in (a, b) if r < part]] = False
        self.cuts = Vocabulary([np.frombuffer(x, dtype=np.uint8) for x in self.ranks])
        table = sorted((a << 32 | b, r) for a, b, r in pairs)
        self.pair_keys, self.pair_ranks = (np.array(x) for x in zip(*table, strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})
        self._load("merges", ab=[a << 32 | b for a, b, _ in pairs], rank=pa.array([r for _, _, r in pairs], pa.int32()), safe=safe[[r for _, _, r in pairs]])
        self._load("vocabulary", id=list(self.ranks.values()), bytes_hex=[x.hex() for x in self.ranks])
        self.words = RecentCache(CACHED_BYTES)
        self.runs = RecentCache(CACHED_RUN_BYTES)

    def _load(self, name: str, **columns) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn_words(self, words: list[str]) -> None:
        """Put the ids of the words (as little-endian 32-bit) in the cache."""
        self.words.weight += ENTRY_BYTES * len(words) + 2 * sum(map(len, words))
        raw = [w.encode() for w in words]
        whole = list(map(self.ranks.get, raw))
        self.words.update((w, r.to_bytes(4, "little")) for w, r in zip(words, whole, strict=True) if r is not None)
        rest = [(w, x) for w, x, r in zip(words, raw, whole, strict=True) if r is None]
        short = [(w, x) for w, x in rest if len(x) <= LONG]
        self.words.update(zip((w for w, _ in short), self.contract([x for _, x in short]), strict=True))
        cut = [(w, self.cuts.parts(x)) for w, x in rest if len(x) > LONG]
        if cut:
            parts = list({x for _, p in cut for x in p})
            ids = dict(zip(parts, self.contract(parts), strict=True))
            self.words.update((w, b"".join(map(ids.__getitem__, p))) for w, p in cut)

    def contract(self, raw: list[bytes]) -> list[bytes]:
        """The ids of each of the words, contracted in batches of words alike in length."""
        out: list[bytes] = [self.contract_alone(x) if len(x) > MOST_QUERIED else b"" for x in raw]
        order = sorted((i for i in range(len(raw)) if len(raw[i]) <= MOST_QUERIED), key=lambda i: len(raw[i]))
        for query, group in ((CONTRACT, [i for i in order if len(raw[i]) <= LONG]), (CONTRACT_LONG, [i for i in order if len(raw[i]) > LONG])):
            start = rows = 0
            for k, i in enumerate(group):
                size = len(raw[i])
                made = size * size // 2 if query is CONTRACT else size
                if rows and rows + made > ROWS_AT_ONCE:
                    self._contract(query, raw, group[start:k], out)
                    start, rows = k, 0
                rows += made
            if group:
                self._contract(query, raw, group[start:], out)
        return out

    def _contract(self, query: str, raw: list[bytes], numbers: list[int], out: list[bytes]) -> None:
        sizes = np.fromiter((len(raw[i]) for i in numbers), dtype=np.int64, count=len(numbers))
        w = np.repeat(np.arange(len(numbers), dtype=np.int32), sizes)
        p = (np.arange(len(w)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self.db.register("start", pa.table({"w": w, "p": p, "s": self.byte_ids[np.frombuffer(b"".join([raw[i] for i in numbers]), dtype=np.uint8)]}))
        got = self.db.execute(query).fetchnumpy()
        self.db.unregister("start")
        w, p, s = got["w"], got["p"], got["s"]
        flat = s[np.argsort(w.astype(np.int64) << 32 | p, kind="stable")].astype("<u4").tobytes()
        begin = 0
        for i, end in zip(numbers, (4 * np.cumsum(np.bincount(w, minlength=len(numbers)))).tolist(), strict=True):
            out[i] = flat[begin:end]
            begin = end

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NO_RANK where none merges."""
        out = np.empty(len(left), dtype=np.int32)
        for a in range(0, len(left), SYMBOLS_AT_ONCE):
            want = left[a : a + SYMBOLS_AT_ONCE].astype(np.int64) << 32 | right[a : a + SYMBOLS_AT_ONCE]
            at = np.minimum(np.searchsorted(self.pair_keys, want), len(self.pair_keys) - 1)
            out[a : a + SYMBOLS_AT_ONCE] = np.where(self.pair_keys[at] == want, self.pair_ranks[at], NO_RANK)
        return out

    def contract_alone(self, raw: bytes) -> bytes:
        """The ids of one very long word: every step contracts its pairs of least rank, from the left.

        Up to the first of them whose new token would make an earlier rank with
        a neighbour, that one included, they contract in one step.
        """
        s = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        ranks = self.ranks_of(s[:-1], s[1:])
        while len(ranks) and (low := int(ranks.min())) != NO_RANK:
            hit = np.flatnonzero(ranks == low)
            fresh = np.concatenate(([True], np.diff(hit) > 1))  # else it shares a symbol with the one before
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
            hit = hit[place % 2 == 0]
            new = np.full(len(hit), low, dtype=np.int32)
            before, after = s[np.maximum(hit - 1, 0)], s[np.minimum(hit + 2, len(s) - 1)]
            early = ((self.ranks_of(before, new) < low) & (hit > 0)) | ((self.ranks_of(new, after) < low) & (hit + 2 < len(s)))
            if self.ranks_of(new[:1], new[:1])[0] < low:
                early[:] = True
            hit = hit[: int(early.argmax()) + 1] if early.any() else hit
            s[hit] = low
            keep = np.ones(len(s), dtype=bool)
            keep[hit + 1] = False
            s = s[keep]
            ranks = np.delete(ranks, np.minimum(hit + 1, len(ranks) - 1)) if len(s) > 1 else ranks[:0]
            hit = hit - np.arange(len(hit))
            near = np.unique(np.concatenate((hit[hit > 0] - 1, hit[hit + 1 < len(s)])))
            ranks[near] = self.ranks_of(s[near], s[near + 1])
        return s.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [(self.pattern if BEYOND_LATIN.search(t) else self.latin).findall(t) for t in texts]
        return self.words.joined(cut, self.learn_words)

    def learn_runs(self, runs: list[bytes]) -> None:
        """Put the bytes of the runs of ids in the cache."""
        sizes = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // 4
        ends, start = np.cumsum(sizes), 0
        while start < len(runs):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
            s = np.frombuffer(b"".join(runs[start:stop]), dtype="<u4")
            if len(s) and not (s.max() < len(self.known) and self.known[s].all()):
                raise KeyError("an id is not in the vocabulary")
            r = np.repeat(np.arange(start, stop, dtype=np.int32), sizes[start:stop])
            self.db.register("runs", pa.table({"r": r, "p": np.arange(len(s), dtype=np.int32), "s": s.astype(np.int32)}))
            found = self.db.execute(DECODE).fetchall()
            self.db.unregister("runs")
            self.runs.update((runs[i], bytes.fromhex(whole)) for i, whole in found)
            start = stop
        self.runs.weight += sum(ENTRY_BYTES + 2 * len(x) for x in runs)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence; unknown ids raise KeyError."""
        cut = [[flat[a : a + 4 * RUN_TOKENS] for a in range(0, len(flat), 4 * RUN_TOKENS)] for flat in ids]
        return self.runs.joined(cut, self.learn_runs)


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def digests(texts: list[str], path: str, pattern: str, with_ids: bool = False) -> list[list]:
    codec = load(path, pattern)
    counts, ids_sha, text_sha, out = [], [], [], []
    for _, part in slices(texts, CHARS_AT_ONCE):
        ids = codec.encode(part)
        whole = codec.decode(ids)
        counts += [len(x) // 4 for x in ids]
        ids_sha += [hashlib.sha256(x).hexdigest() for x in ids]
        text_sha += [hashlib.sha256(x).hexdigest() for x in whole]
        if with_ids:
            out += [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids]
    return [counts, ids_sha, text_sha, *[out] * with_ids]


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every row, and the ids if asked.

    Texts are encoded whole and without special tokens (strings that look like
    them are ordinary text), then decoded from the ids alone.  Null and empty
    texts have no tokens and decode to no bytes.  Repeated rows are each
    reported; extra columns are ignored.
    """
    columns = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    columns |= {"ids": ("array<int>", pa.list_(pa.int32()))} if with_ids else {}
    return map_texts(docs, id_col, text_col, columns, lambda texts: digests(texts, path, pattern, with_ids))
