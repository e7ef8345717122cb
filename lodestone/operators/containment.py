"""Which texts hold which terms as substrings, by grams.

A term of at least GRAM characters is looked up by the rarest of its grams;
a text that has this gram is a candidate, and the term itself decides.  A
shorter term is its own gram.  The work grows with the characters of the texts
and with what matches, not with terms times texts.  Few terms go to the texts,
which are read once; many meet them in equi-joins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.operators.lexical import CHARS_AT_ONCE, row_slices
from lodestone.sources.scratch import is_small, saved

GRAM = 4
#: Terms that go to the texts.
TERMS_AT_ONCE = 100_000
#: Texts and characters of each that show which grams are rare, which decides the speed only.
SAMPLE, SAMPLE_CHARS = 200, 2_000
#: Places of a text looked at together, and bits by which most are told apart at once.
PLACES_AT_ONCE, BITS = 1 << 19, 20
#: Odd numbers that spread codes and the numbers of grams.
FACTOR, SPREAD, MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1


def _numbered(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` codes; equal runs have equal ones."""
    if len(codes) < size:
        return codes[:0]
    part, width, factor, out, have = codes * np.uint64(SPREAD), 1, FACTOR, None, 0
    while size:
        if size & 1:  # runs of the width follow those made so far
            n = len(codes) - have - width + 1
            out, have = (part if out is None else out[:n] * np.uint64(factor) + part[have : have + n]), have + width
        size >>= 1
        if size:
            n = len(part) - width
            part, width, factor = part[:n] * np.uint64(factor) + part[width:], 2 * width, factor * factor & MASK
    out = out ^ (out >> np.uint64(32))
    return out * np.uint64(SPREAD)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class Matcher:
    """Which of many distinct terms texts hold; ``texts`` show which grams are rare."""

    def __init__(self, terms: list[str], texts: list[str | None], size: int = GRAM):
        self.terms = terms
        wanted = {t[i : i + size] for t in terms for i in range(len(t) - size + 1)}
        seen = Counter(g for t in texts[:SAMPLE] if t for i in range(min(len(t), SAMPLE_CHARS) - size + 1) if (g := t[i : i + size]) in wanted)
        probes: dict[int, dict[str, list[int]]] = {}
        for i, term in enumerate(terms):
            if term:
                grams = {term[k : k + size] for k in range(len(term) - size + 1)} or {term}
                probes.setdefault(min(len(term), size), {}).setdefault(min(grams, key=lambda g: (seen[g], g)), []).append(i)
        self.kinds = [(n, *self._table(n, by)) for n, by in sorted(probes.items())]

    @staticmethod
    def _table(size: int, by: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For grams of a size: which first bits any has, their numbers in order, and the terms of each."""
        owners: dict[int, list[int]] = {}
        for gram, own in by.items():
            owners.setdefault(int(_numbered(_codes(gram), size)[0]), []).extend(own)
        numbers = np.array(sorted(owners), dtype=np.uint64)
        near = np.zeros(1 << BITS, dtype=bool)
        near[(numbers >> np.uint64(64 - BITS)).astype(np.int64)] = True
        many = np.array([len(owners[n]) for n in numbers.tolist()], dtype=np.int64)
        return near, numbers, np.cumsum(many) - many, many, np.array([i for n in numbers.tolist() for i in owners[n]], dtype=np.int64)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The texts and the terms that they hold, by their numbers and in order."""
        texts = [t or "" for t in texts]
        codes, ends = _codes("".join(texts)), np.cumsum([len(t) for t in texts], dtype=np.int64)
        pairs = [np.empty(0, dtype=np.int64)]
        for size, near, numbers, start, many, owners in self.kinds:
            for low in range(0, len(codes), PLACES_AT_ONCE):
                found = _numbered(codes[low : low + PLACES_AT_ONCE + size - 1], size)
                at = np.flatnonzero(near[(found >> np.uint64(64 - BITS)).astype(np.int64)])
                place = np.minimum(np.searchsorted(numbers, found[at]), len(numbers) - 1)
                sure = numbers[place] == found[at]
                at, place = at[sure] + low, place[sure]
                row = np.searchsorted(ends, at, side="right")
                inside = at + size <= ends[row]
                row, place = np.divmod(np.unique(row[inside] * len(numbers) + place[inside]), len(numbers))
                n = many[place]
                term = owners[np.repeat(start[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pairs.append(np.repeat(row, n) * len(self.terms) + term)
        row, term = np.divmod(np.unique(np.concatenate(pairs)), max(1, len(self.terms)))
        held = np.fromiter((self.terms[t] in texts[r] for r, t in zip(row.tolist(), term.tolist(), strict=True)), dtype=bool, count=len(row))
        return row[held], term[held]


def grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def probes(terms: DataFrame, texts: DataFrame, size: int = GRAM, text_col: str = "normal") -> DataFrame:
    """term and probe: the term's gram that the fewest texts have (ties by the gram), or the term itself if it is shorter."""
    known = terms.select("term").filter("term <> ''").distinct()
    own = known.filter(F.length("term") >= size).select("term", F.explode(grams(F.col("term"), size)).alias("probe"))
    own = saved(own, "grams")
    wanted = own.select("probe").distinct()
    seen = texts.select(F.explode(grams(F.col(text_col), size)).alias("probe"))
    counts = seen.join(F.broadcast(wanted) if is_small(wanted) else wanted, "probe").groupBy("probe").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("term").orderBy(F.coalesce("n", F.lit(0)), "probe")
    best = own.join(counts, "probe", "left").withColumn("at", F.row_number().over(order)).filter("at = 1")
    short = known.filter(F.length("term") < size).select("term", F.col("term").alias("probe"))
    return saved(best.select("term", "probe").unionByName(short), "probes")


def holding(terms: DataFrame, texts: DataFrame, id_cols: list[str], text_col: str = "normal", size: int = GRAM) -> DataFrame:
    """The id columns and term: every text (null as empty) with every distinct term that it holds.

    Empty and null terms are left out; the id columns must tell the texts
    apart.  Terms go to every executor if a check shows them small, and a text
    is looked through where it is read; else probes go there if they are small
    or are joined by shuffle, with ids and grams only, and the candidates
    fetch their texts.
    """
    if size < 1:
        raise ValueError("size must be positive")
    known = terms.select("term").filter("term <> ''").distinct()
    if is_small(known, TERMS_AT_ONCE):
        return _looked_through(sorted(r.term for r in known.collect()), texts, id_cols, text_col, size)  # a check has shown them small
    texts = texts.select(*id_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = probes(terms, texts, size, "_text")
    lengths = sorted(r.n for r in found.select(F.least(F.length("probe"), F.lit(size)).alias("n")).distinct().collect())  # at most ``size`` rows
    if not lengths:
        return texts.select(*id_cols, F.lit("").alias("term")).filter(F.lit(False))
    held = F.explode(F.concat(*(grams(F.col("_text"), n) for n in lengths))).alias("probe")
    sure = (F.length("term") < size) | F.col("_text").contains(F.col("term"))
    if is_small(found):
        return texts.select(*id_cols, "_text", held).join(F.broadcast(found), "probe").filter(sure).select(*id_cols, "term")
    pairs = texts.select(*id_cols, held).join(found, "probe").select(*id_cols, "term")
    return pairs.join(texts, id_cols).filter(sure).select(*id_cols, "term")


def _looked_through(terms: list[str], texts: DataFrame, id_cols: list[str], text_col: str, size: int) -> DataFrame:
    """``holding`` of terms that go to the texts: nothing is shuffled."""
    schema = StructType([*(texts.schema[c] for c in id_cols), StructField("term", StringType())])
    form = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, listed = None, pa.array(terms, pa.string())
        for batch in batches:
            for part, said in row_slices(batch, len(id_cols), CHARS_AT_ONCE):
                held = held or Matcher(terms, said, size)
                row, term = held(said)
                if len(row):
                    made = [*(part.column(i).take(pa.array(row)) for i in range(len(id_cols))), listed.take(pa.array(term))]
                    yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(made, form, strict=True)], schema=form)

    wanted = texts.select(*id_cols, F.col(text_col).alias("_text"))
    return wanted.mapInArrow(run, schema) if terms else wanted.select(*id_cols, F.lit("").alias("term")).filter(F.lit(False))
