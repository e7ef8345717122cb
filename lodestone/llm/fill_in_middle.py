"""Fill-in-the-middle: a text cut in three at unit boundaries and put in another order.

A text becomes an array of code points (UTF-32).  Every code point has a
class; a unit ends wherever two neighbours are of different classes, which one
comparison of the array with itself shows.  Two ranks chosen among the
boundaries cut prefix, middle and suffix, which are slices of the array,
encoded again between the markers.  The digest of a salted id chooses, so the
same document is always cut alike, on any machine and in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def text_of(code: np.ndarray) -> str:
    return code.tobytes().decode("utf-32-le", "surrogatepass")


def line_classes(code: np.ndarray) -> np.ndarray:
    """How many line feeds stand before: alike within a line and its own line feed."""
    return np.cumsum(code == 10, dtype=np.int32) - (code == 10)


def word_classes(code: np.ndarray) -> np.ndarray:
    """White space and line feeds of ASCII, or anything else: a unit is a run of either."""
    return (code == 32) | (code - 9 <= 4)


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"lines": line_classes, "words": word_classes}


def boundaries(code: np.ndarray, units: str = "lines") -> np.ndarray:
    """Where units begin and end: 0, every inner boundary, the length; a text without code points has the one boundary 0."""
    if not len(code):
        return np.zeros(1, dtype=np.int64)
    kinds = UNITS[units](code)
    return np.concatenate(([0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(code)]))


def draws(doc_id, salt: str) -> list[int]:
    """Four numbers of 32 bits from the salted decimal id; a null id counts as no digits."""
    found = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(found[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(text: str, doc_id, salt: str, units: str, rate: int, spm_rate: int) -> tuple:
    """(units, form, code points of prefix and middle, output)."""
    code = code_points(text)
    edges = boundaries(code, units)
    n = len(edges) - 1
    a, b, chance, order = draws(doc_id, salt)
    if not text or chance % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((int(edges[a % (n + 1)]), int(edges[b % (n + 1)])))
    prefix, middle, suffix = (text_of(code[i:j]) for i, j in ((0, first), (first, second), (second, len(code))))
    if order % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "7", units: str = "lines", rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """One row per row of docs: id, n (units), form, prefix_chars, middle_chars, output.

    ``rate`` per cent of the texts are transformed, of those ``spm_rate`` per
    cent suffix first.  A null text counts as empty; empty texts and those that
    hold a marker stay plain (no lengths, the text as output).  Repeated rows
    are cut alike; a null id counts as one without digits; extra columns are
    ignored; no rows give no rows.  Whole texts are worked on, one that is
    longer than a slice alone.
    """
    if units not in UNITS:
        raise ValueError(f"unknown units: {units}")
    columns = {"n": ("long", pa.int64()), "form": ("string", pa.string()), "prefix_chars": ("long", pa.int64()), "middle_chars": ("long", pa.int64()), "output": ("string", pa.string())}

    def work(texts: list[str], ids: list) -> list[list]:
        found = [transform(t, i, salt, units, rate, spm_rate) for t, i in zip(texts, ids, strict=True)]
        return [list(c) for c in zip(*found, strict=True)] if found else [[] for _ in columns]

    return map_texts(docs, id_col, text_col, columns, work, with_ids=True)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from output and form alone, in native expressions.

    No piece holds a marker and no marker can begin inside another, so the
    first place of each marker is where it was put.
    """
    at = lambda mark: F.locate(mark, F.col(output))
    since = lambda mark: F.substring(F.col(output), at(mark) + len(mark), F.length(F.col(output)))
    between = lambda mark, end: F.substring(F.col(output), at(mark) + len(mark), at(end) - at(mark) - len(mark))
    psm = F.concat(between(PREFIX, SUFFIX), since(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), since(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
