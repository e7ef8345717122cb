"""Token counts by rank-synchronous merging of ragged arrays.

The vocabulary is a sentencepiece BPE model with byte fallback.  Texts are cut
into pre-tokens where no merge can reach across; distinct pre-tokens of a
slice become one ragged array of symbols, and in every step each sequence
applies its lowest-ranked pair, all sequences at once.  Where a sequence holds
that pair several times, all of them merge in the step if that is the same as
one after the other from the left: if no piece that the merged one would make
with a neighbour ranks before it.  A sequence without a pair left leaves the
array with its count of surviving symbols.  A symbol that the vocabulary lacks
counts its UTF-8 bytes.

Cuts are derived from the vocabulary: a word mark (the stand-in for a space)
opens a pre-token wherever no piece holds a mark after another character, and
a line feed stands alone wherever no longer piece holds one.  Long pre-tokens
(text without spaces) are cut further wherever no piece reaches across.
Arrays hold at most SYMBOLS_AT_ONCE symbols, or one sequence without any cut.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.batches import BoundedCache, map_texts, slices
from lodestone.llm.cuts import Vocabulary

MARK = "▁"
NONE = np.iinfo(np.int64).max
#: Sequences of more symbols are cut where no piece reaches across.
LONG = 32
SYMBOLS_AT_ONCE = 1_000_000
#: Bytes that the marked, or the bare, words of a worker's cache take at most, and what an entry takes besides its text; longer words are not kept.
CACHED_BYTES, ENTRY_BYTES, LONGEST_KEPT = 100_000_000, 160, 256


class PieceModel:
    """Ranks of a sentencepiece BPE model and its ragged-array counter."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                pieces[model.id_to_piece(i)] = i
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        order = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                a, b = pieces.get(piece[:k]), pieces.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a, b] = (order[model.get_score(i)], i)
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        self.base = model.get_piece_size() + 1
        keys = np.array([a * self.base + b for a, b in pairs], dtype=np.int64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.ranks = np.array([r for r, _ in pairs.values()], dtype=np.int64)[by]
        self.made = np.array([m for _, m in pairs.values()], dtype=np.int64)[by]
        #: Lookup of characters in the basic plane; -1: not in the vocabulary.
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for c, i in self.chars.items():
            self.char_ids[ord(c)] = i
        self.rank_of = np.full(self.base, NONE, dtype=np.int64)
        for i in pieces.values():
            self.rank_of[i] = order[model.get_score(i)]
        longer = [p for p in pieces if len(p) > 1]
        self.cuts = Vocabulary([self.char_ids[[ord(c) for c in p]] + 1 for p in longer])
        if any(p[k] == MARK != p[k - 1] for p in longer for k in range(1, len(p))) or any("\n" in p for p in longer):
            raise ValueError("the vocabulary merges across word marks or line feeds")
        self.feed = 1
        checks = {"a b": f"{MARK}a{MARK}b", " a  b ": f"{MARK}{MARK}a{MARK}{MARK}b{MARK}", "ﬁ²": f"{MARK}ﬁ²"}
        if any(model.normalize(x) != y for x, y in checks.items()):
            raise ValueError("the model rewrites its input; only plain space marking is supported")

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no merge) and its row in the pair table."""
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = (self.keys[at] == want) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), at

    def count_words(self, words: list[str]) -> list[int]:
        """Surviving symbols of each word, all words of a batch merged in step."""
        pieces, owners = [], []
        for n, word in enumerate(words):
            if len(word) <= LONG:
                pieces.append(word)
                owners.append(n)
                continue
            edges = [0, *self.cuts.cuts(self.char_ids[_code_points(word)] + 1).tolist(), len(word)]
            pieces += [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            owners += [n] * (len(edges) - 1)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        counts, order = np.zeros(len(pieces), dtype=np.int64), np.argsort(sizes, kind="stable")
        ends, start = np.cumsum(sizes[order]), 0
        while start < len(order):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SYMBOLS_AT_ONCE, side="right")))
            ids = order[start:stop]
            ids = ids[sizes[ids] > 0]
            if len(ids):
                counts[ids] = self._merge("".join(pieces[i] for i in ids), sizes[ids])
            start = stop
        return np.bincount(np.array(owners, dtype=np.int64), counts, minlength=len(words)).astype(np.int64).tolist() if words else []

    def _merge(self, text: str, size: np.ndarray) -> np.ndarray:
        """Surviving symbols of each of the sequences, of the given sizes, that the text strings together."""
        out, ids = np.zeros(len(size), dtype=np.int64), np.arange(len(size))
        code = _code_points(text)
        sym = self.char_ids[code].astype(np.int64)
        starts = np.cumsum(size) - size
        spare = np.where(sym < 0, 0 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 0)
        out += np.add.reduceat(spare, starts)
        del code, spare
        last = np.zeros(len(sym), dtype=bool)
        last[starts + size - 1] = True
        rank = np.full(len(sym), NONE, dtype=np.int64)
        made = np.zeros(len(sym), dtype=np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], at = self._find(sym[inner], sym[inner + 1])
        made[inner] = self.made[at]
        while len(ids):
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                out[ids[done]] += size[done]
                stay = np.repeat(~done, size)
                sym, rank, made, last = sym[stay], rank[stay], made[stay], last[stay]
                ids, size, low = ids[~done], size[~done], low[~done]
                starts = np.cumsum(size) - size
                if not len(ids):
                    break
            least = np.flatnonzero(rank == np.repeat(low, size))
            hit = self._chosen(least, starts, sym, made, last)
            sym[hit] = made[hit]
            last[hit] = last[hit + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, rank, made, last = sym[keep], rank[keep], made[keep], last[keep]
            size = size - np.bincount(np.searchsorted(starts, hit, side="right") - 1, minlength=len(size))
            starts = np.cumsum(size) - size
            hit = hit - np.arange(len(hit))
            before = hit[hit > starts[np.searchsorted(starts, hit, side="right") - 1]] - 1
            rank[hit] = NONE
            near = np.concatenate((hit[~last[hit]], before))
            rank[near], at = self._find(sym[near], sym[near + 1])
            made[near] = self.made[at]
        return out

    def _chosen(self, least: np.ndarray, starts: np.ndarray, sym: np.ndarray, made: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of the lowest pairs of every sequence those that merge in this step, the leftmost always."""
        word = np.searchsorted(starts, least, side="right") - 1
        first = np.concatenate(([True], word[1:] != word[:-1]))
        if first.all():
            return least
        new, after = made[least], np.minimum(least + 2, len(sym) - 1)
        right = np.where(last[least + 1], -1, sym[after])
        left = np.where(least > starts[word], sym[np.maximum(least - 1, 0)], -1)
        own = self.rank_of[new]
        doubt = (self._find(new, right)[0] < own) | (self._find(left, new)[0] < own) | (self._find(new, new)[0] < own)
        single = np.zeros(len(starts), dtype=bool)
        single[word[doubt]] = True
        fresh = first | np.concatenate(([True], np.diff(least) > 1))  # else the pair shares a symbol with the one before
        place = np.arange(len(least)) - np.maximum.accumulate(np.where(fresh, np.arange(len(least)), 0))
        return least[np.where(single[word], first, place % 2 == 0)]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=2)
def load(path: str) -> tuple[PieceModel, BoundedCache, BoundedCache]:
    """The model of this worker with its caches of marked and bare words."""
    return PieceModel(path), BoundedCache(CACHED_BYTES), BoundedCache(CACHED_BYTES)


ODD = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


def pre_tokens(text: str) -> tuple[list[str], list[str], int]:
    """Words that a mark opens (given without it), other words, line feeds."""
    if not text:
        return [], [], 0
    if "  " in text or MARK in text or text[0] == " ":
        found = ODD.findall(MARK + text.replace(" ", MARK))
        words = [w for w in found if w != "\n"]
        return [], words, len(found) - len(words)
    first, *lines = text.split("\n")
    marked, bare = first.split(" "), []
    for line in lines:
        head, *rest = line.split(" ")
        if head:
            bare.append(head)
        marked += rest
    return marked, bare, len(lines)


def count_texts(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    model, marked, bare = load(path)
    out = []
    for _, part in slices(texts):
        cut = [pre_tokens(t) for t in part]
        marked.make_room()
        bare.make_room()
        for cache, mark, words in ((marked, MARK, {w for c in cut for w in c[0]}), (bare, "", {w for c in cut for w in c[1]})):
            new = [w for w in words if w not in cache]
            cache.update(zip(new, model.count_words([mark + w for w in new]), strict=True))
            cache.weight += sum(ENTRY_BYTES + 4 * len(w) for w in new)
        out += [sum(map(marked.__getitem__, a)) + sum(map(bare.__getitem__, b)) + n * model.feed for a, b, n in cut]
        for cache, at in ((marked, 0), (bare, 1)):
            for w in {w for c in cut for w in c[at] if len(w) > LONGEST_KEPT} & cache.keys():
                del cache[w]
                cache.weight -= ENTRY_BYTES + 4 * len(w)
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit.

    Whole texts, without begin or end tokens; strings that look like special
    tokens are ordinary text.  Null counts as empty: 0 bytes, 0 tokens.
    Repeated rows are each counted; extra columns are ignored.
    """

    def work(texts: list[str]) -> list[list]:
        counts = count_texts(texts, path)
        return [[len(t.encode()) for t in texts], counts, [n > limit for n in counts]]

    columns = {"n_bytes": ("long", pa.int64()), "n_tokens": ("long", pa.int64()), "over_limit": ("boolean", pa.bool_())}
    return map_texts(docs, id_col, text_col, columns, work)
