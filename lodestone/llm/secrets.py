"""Secret scanning through a trigram index.

Each rule is a regular expression.  From its parse tree a Boolean trigram
query is derived: a text can only match if it holds every trigram of an AND
node and at least one side of an OR node.  Every batch of documents gets an
inverted index (trigram -> sorted row numbers) of exactly the trigrams that
the rules ask for; the rules' queries are answered by intersecting and uniting
postings, and only the candidates are scanned with the regex.  A rule that has
no mandatory trigram (a run of hex digits) scans every document.

Trigrams are of UTF-8 bytes with A-Z folded to a-z, so that one index serves
rules with and without regard to case; folding only ever adds candidates, and
candidates are verified on the text as it is.  A rule that ignores the case of
letters beyond ASCII too has no trigrams from letters that this lets match
others (a long s for an s).  The index is built in one pass over the batch's
bytes.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field
from functools import reduce
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.batches import map_texts

# ---------------------------------------------------------------- trigram queries

#: A query is True (no restriction), a trigram, or ("and"|"or", parts).
#: Sets of literal strings are followed up to this many members.
MOST_STRINGS = 64


def conj(*parts):
    flat = {p for q in parts if q is not True for p in (q[1] if isinstance(q, tuple) and q[0] == "and" else [q])}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def disj(*parts):
    if any(p is True for p in parts):
        return True
    flat = {p for q in parts for p in (q[1] if isinstance(q, tuple) and q[0] == "or" else [q])}
    sides = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else {p} for p in flat}
    flat = {p for p in flat if not any(sides[q] < sides[p] for q in flat)}  # what asks for more adds nothing
    return next(iter(flat)) if len(flat) == 1 else ("or", frozenset(flat))


def of_strings(strings) -> object:
    """What a text's folded bytes must hold if it holds one of the strings."""
    held = [s.encode("utf-8", "surrogatepass").lower() for s in strings]
    return disj(*(conj(*(s[i : i + 3] for i in range(len(s) - 2))) for s in held)) if held else True


def _fold(text: str) -> str:
    return "".join(c.lower() if c < "\x80" else c for c in text)


def _shifts(code: int) -> bool:
    """Whether a character may match one outside ASCII, or is one with cases, when case is ignored."""
    c = chr(code)
    return c in "iIkKsS" or c >= "\x80" and (c.lower() != c or c.upper() != c or c.casefold() != c)


def _strings(node, wide: bool) -> set[str] | None:
    """All strings a parse node can match, if they are few; else None.  ``wide``: case is ignored beyond ASCII."""
    op, arg = node
    if op is sre.LITERAL:
        return None if wide and _shifts(arg) else {_fold(chr(arg))}
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        span = [range(a, a + 1) if o is sre.LITERAL else range(a[0], a[1] + 1) for o, a in arg]
        if sum(map(len, span)) <= 4 and not (wide and any(_shifts(c) for r in span for c in r)):
            return {_fold(chr(c)) for r in span for c in r}
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
        one = _sequence_strings(arg[2], wide)
        if one is not None and len(one) ** arg[1] <= MOST_STRINGS:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in itertools.product(one, repeat=n)}
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3], wide)
    if op is sre.BRANCH:
        sides = [_sequence_strings(s, wide) for s in arg[1]]
        if all(s is not None for s in sides):
            return set().union(*sides)
    if op is sre.AT:
        return {""}
    return None


def _sequence_strings(nodes, wide: bool) -> set[str] | None:
    made = {""}
    for node in nodes:
        more = _strings(node, wide)
        if more is None or len(made) * len(more) > MOST_STRINGS:
            return None
        made = {a + b for a in made for b in more}
    return made


def _sequence_query(nodes, wide: bool) -> object:
    parts, run = [], {""}
    for node in nodes:
        more = _strings(node, wide)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        parts.append(of_strings(run))
        run = {""} if more is None else more
        if more is None:
            op, arg = node
            if op is sre.SUBPATTERN:
                parts.append(_sequence_query(arg[3], wide))
            elif op is sre.BRANCH:
                parts.append(disj(*(_sequence_query(s, wide) for s in arg[1])))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(_sequence_query(arg[2], wide))
    return conj(*parts, of_strings(run))


def trigram_query(pattern: str, flags: int = 0) -> object:
    """The Boolean trigram query (over folded text) that a match implies."""
    parsed = sre_parser.parse(pattern, flags)
    own = parsed.state.flags | _inner_flags(parsed)
    return _sequence_query(parsed, bool(own & re.I) and not own & re.A)


def _inner_flags(nodes) -> int:
    """Flags that groups inside the pattern set for themselves."""
    out = 0
    for op, arg in nodes:
        if op is sre.SUBPATTERN:
            out |= arg[1] | _inner_flags(arg[3])
        elif op is sre.BRANCH:
            for side in arg[1]:
                out |= _inner_flags(side)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            out |= _inner_flags(arg[2])
    return out


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(p) for p in query[1]))


def postings(texts: list[str], wanted) -> dict[bytes, np.ndarray]:
    """Inverted index of the wanted trigrams: row numbers in rising order."""
    rows = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(x) + 2 for x in rows], dtype=np.int64)
    flat = np.frombuffer(b"\x00\x00".join(rows) + b"\x00\x00", dtype=np.uint8)
    names = sorted(g for g in wanted if b"\x00" not in g)
    codes = np.array([int.from_bytes(g, "big") for g in names], dtype=np.int64)
    opens = np.zeros(1 << 16, dtype=bool)
    opens[codes >> 8] = True
    pair = flat[:-1].astype(np.uint16) << 8 | flat[1:]
    at = np.flatnonzero(opens[pair[:-1]])
    found = pair[at].astype(np.int64) << 8 | flat[at + 2]
    place = np.minimum(np.searchsorted(codes, found), max(len(codes) - 1, 0))
    real = codes[place] == found if len(codes) else np.zeros(0, dtype=bool)
    key = np.unique(place[real] * len(rows) + np.searchsorted(ends, at[real], side="right"))
    edges = np.searchsorted(key, np.arange(len(names) + 1) * len(rows))
    index = {g: key[edges[n] : edges[n + 1]] - n * len(rows) for n, g in enumerate(names)}
    # A trigram with a zero byte could run into the next text: it is looked up text by text.
    index.update({g: np.fromiter((i for i, x in enumerate(rows) if g in x), dtype=np.int64) for g in wanted if b"\x00" in g})
    return index


def lookup(query, index: dict[str, np.ndarray], rows: int) -> np.ndarray:
    if query is True:
        return np.arange(rows)
    if isinstance(query, bytes):
        return index[query]
    parts = sorted((lookup(p, index, rows) for p in query[1]), key=len)
    if query[0] == "or":
        return reduce(np.union1d, parts)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True), parts)


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """A kind of secret; matches whose checked group is short are dropped."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0
    base: bool = False
    query: object = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern, self.flags))


#: The three base rules come first, in the order of their kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]+", 0, 0, 40),
    # Begins where a run of its letters does, so that each run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
#: What a hex match that passes must look like; finds the same spans without stopping at every short run.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def _finder(rule: Rule):
    if rule.kind == "hex" and rule.least == 24:
        return lambda text: [(m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    compiled = re.compile(rule.pattern, rule.flags)

    def find(text: str) -> list[tuple[int, int]]:
        return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]

    return find


def scan(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans as (start, rule number, end), sorted."""
    wanted = set().union(*(trigrams(r.query) for r in rules))
    index = postings(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, rule in enumerate(rules):
        find = _finder(rule)
        for row in lookup(rule.query, index, len(texts)):
            found[row] += [(a, number, b) for a, b in find(texts[row])]
    for spans in found:
        spans.sort()
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, kind counts of the base rules, spans.

    ``base_spans`` and ``spans`` are ``kind:start:end`` joined by commas, by
    start and then in the order of the rules; offsets are code points, ends
    exclusive.  Null text counts as empty and has no spans.  Repeated rows are
    each reported; extra columns are ignored; an empty table gives no rows.
    """
    base = [i for i, r in enumerate(rules) if r.base]

    def work(texts: list[str]) -> list[list]:
        found = scan(texts, rules)
        said = [[(n, f"{rules[n].kind}:{a}:{b}") for a, n, b in spans] for spans in found]
        spans = [",".join(x for _, x in s) for s in said]
        base_spans = [",".join(x for n, x in s if rules[n].base) for s in said]
        return [spans, base_spans, *([sum(n == i for n, _ in s) for s in said] for i in base)]

    columns = {"spans": ("string", pa.string()), "base_spans": ("string", pa.string())}
    columns |= {f"n_{rules[i].kind}": ("long", pa.int64()) for i in base}
    return map_texts(docs, id_col, text_col, columns, work)
