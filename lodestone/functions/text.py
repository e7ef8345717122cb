"""Text functions as column expressions.

Everything is a built-in expression but compatibility normalisation, which no
built-in offers: texts that it can change go through an Arrow batch function,
all others are handed over as nulls and keep their value.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str methods and patterns see it, for Java patterns with (?U), and its characters.
SPACE = r"\s\x1c-\x1f"
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Han ranges of the lexical index, of concepts and queries.
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2fa1f}\x{30000}-\x{323af}"
HAN_BASIC = r"\x{4e00}-\x{9fff}"
#: Nouns too common to be a concept, and words that mark a complex question.
GENERIC_CONCEPTS = ("公司", "报告", "情况", "说明", "项目", "数据", "信息", "内容", "合计")
COMPLEX_MARKERS = ("分别", "比较", "原因", "条件", "步骤", "影响", "以及", "同时")
NO_CHAPTER = "未分类"
#: Characters that compatibility normalisation leaves alone in any context within the set.
STABLE = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]*$"
#: Characters that compatibility normalisation turns into text with a digit of 0 to 9, and wider ranges that tell most other characters apart at once.
DIGITS = (
    r"\x{b2}-\x{b3}\x{b9}\x{bc}-\x{be}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2150}-\x{215f}\x{2189}\x{2460}-\x{249b}\x{24ea}\x{3251}-\x{325f}\x{32b1}-\x{32cb}"
    r"\x{3358}-\x{3370}\x{3378}-\x{3379}\x{339f}-\x{33a6}\x{33a8}\x{33af}\x{33e0}-\x{33fe}\x{ff10}-\x{ff19}\x{1d7ce}-\x{1d7ff}\x{1f100}-\x{1f10a}\x{1fbf0}-\x{1fbf9}"
)
DIGITS_WIDELY = r"\x{b2}-\x{be}\x{2070}-\x{33ff}\x{ff10}-\x{1fbff}"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(~text.rlike(STABLE), text)), text)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACES))


def folded(text: Column) -> Column:
    return F.lower(nfkc(F.coalesce(text, F.lit(""))))


def normalize_evidence(text: Column) -> Column:
    """Folded, without thousands commas, white space, separators and stray dots."""
    value = F.regexp_replace(folded(text), r"(?U)(?<=\d),(?=\d{3}(?:\D|$))", "")
    value = F.regexp_replace(value, f"(?U)[{SPACE},;:，；：]+", "")
    return F.regexp_replace(value, r"(?U)(?<!\d)\.|\.(?!\d)", "")


def bigrams(run: Column) -> Column:
    """Overlapping pairs of characters; none for fewer than two."""
    chars = F.split(run, "")
    return F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.concat(a, b))


def lexical_terms(text: Column) -> Column:
    """Identifiers and overlapping Han pairs in order, repeats kept."""
    value = folded(text)
    runs = F.regexp_extract_all(value, F.lit(f"([{HAN}]+|[a-z0-9_-]+)"), F.lit(1))
    none = F.array().cast("array<string>")

    def terms(run: Column) -> Column:
        ascii_run = run.rlike("^[a-z0-9_-]")
        return F.when(ascii_run & ~run.rlike("[a-z0-9]"), none).when(ascii_run | (F.length(run) == 1), F.array(run)).otherwise(bigrams(run))

    # Without Han there are identifiers only, which one pattern finds; it begins at a run's start, so that marks alone cost one look.
    names = F.regexp_extract_all(value, F.lit("((?<![a-z0-9_-])[_-]*+[a-z0-9][a-z0-9_-]*+)"), F.lit(1))
    return F.when(value.rlike(f"[{HAN}]"), F.flatten(F.transform(runs, terms))).otherwise(names)


def _ranges(java: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: chr(int(m[1], 16)), java)


_HAN_SEEN = re.compile(f"[{_ranges(HAN)}]")
_RUNS = re.compile(f"([{_ranges(HAN)}]+)|((?<![a-z0-9_-])[_-]*+[a-z0-9][a-z0-9_-]*+)")
_NAMES = re.compile("(?<![a-z0-9_-])[_-]*+[a-z0-9][a-z0-9_-]*+")
_CANDIDATES = re.compile(f"[{_ranges(HAN_BASIC)}]{{2,12}}|[A-Za-z][A-Za-z0-9_-]{{1,23}}")


def terms_of(text: str | None) -> list[str]:
    """As ``lexical_terms``, of one text."""
    value = unicodedata.normalize("NFKC", text or "").lower()
    if value.isascii() or not _HAN_SEEN.search(value):
        return _NAMES.findall(value)
    out = []
    for han, name in _RUNS.findall(value):
        if name:
            out.append(name)
        else:
            out += [han] if len(han) == 1 else map("".join, zip(han, han[1:], strict=False))
    return out


def candidates_of(text: str | None) -> list[str]:
    """As ``concept_candidates``, of one text."""
    return [c for c in _CANDIDATES.findall(text or "") if c not in GENERIC_CONCEPTS]


def encoded_term(term: Column) -> Column:
    """t and the UTF-8 bytes in lower-case hex; no two terms share one."""
    return F.concat(F.lit("t"), F.lower(F.hex(F.encode(term, "UTF-8"))))


def index_text(text: Column) -> Column:
    return F.array_join(F.transform(lexical_terms(text), encoded_term), " ")


def match_literals(text: Column) -> Column:
    """The distinct terms as quoted literals joined by OR; empty without terms."""
    return F.array_join(F.transform(F.array_distinct(lexical_terms(text)), lambda t: F.concat(F.lit('"'), encoded_term(t), F.lit('"'))), " OR ")


def valid_concept(concept: Column) -> Column:
    value = strip(F.coalesce(concept, F.lit("")))
    return F.length(value).between(2, 24) & ~value.isin(*GENERIC_CONCEPTS) & ~value.rlike(r"(?U)^[\d\W_]+$")


def concept_candidates(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"([{HAN_BASIC}]{{2,12}}|[A-Za-z][A-Za-z0-9_-]{{1,23}})"), F.lit(1))
    return F.filter(found, lambda c: ~c.isin(*GENERIC_CONCEPTS))


def extract_concepts(text: Column, limit: int = 6) -> Column:
    """The most frequent concepts, ties by first place; for short texts.

    Long texts are better served by the relational form in operators.graph.
    """
    found = concept_candidates(text)
    ranked = F.transform(
        F.array_distinct(found),
        lambda c: F.struct((-F.size(F.filter(found, lambda x: x == c))).alias("n"), F.array_position(found, c).alias("at"), c.alias("concept")),
    )
    return F.transform(F.slice(F.array_sort(ranked), 1, limit), lambda s: s["concept"])


def query_terms(text: Column) -> Column:
    """Distinct terms of a question for substring matching.

    Identifiers come from the normal form, which has no white space, and Han
    pairs run over all Han characters joined; concepts of the raw text follow.
    """
    normal = normalize_evidence(text)
    names = F.regexp_extract_all(normal, F.lit("([a-z0-9_-]{2,})"), F.lit(1))
    han = F.regexp_replace(normal, f"[^{HAN_BASIC}]", "")
    return F.array_distinct(F.concat(names, bigrams(han), extract_concepts(text)))


def numeric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_evidence(text), F.lit(r"(\d+(?:\.\d+)?%?)"), F.lit(1))


def has_digits(text: Column) -> Column:
    """Whether the normal form of a text holds a digit of 0 to 9."""
    return text.rlike(f"[0-9]|(?=[{DIGITS_WIDELY}])[{DIGITS}]")


def numbers_of(text: Column) -> Column:
    """The distinct runs of digits, dots and percent signs of the normal form, joined by blanks: it holds the numeric tokens that the normal form holds."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(normalize_evidence(text), F.lit("([0-9][0-9.%]*+)"), F.lit(1))), " ")


def chapter_guess(text: Column) -> Column:
    """The first line if it is short, stripped of hashes and colons."""
    line = F.regexp_replace(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")[0], "^[ #：:]+|[ #：:]+$", "")
    return F.when(F.length(line).between(2, 30), line).otherwise(NO_CHAPTER)


def document_id(path: Column) -> Column:
    """Sanitised stem of at most 30 characters, underscore, 12 hex of the path's md5."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    stem = F.when(name.rlike(r"^\.+[^.]*$"), name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))
    safe = F.substring(F.regexp_replace(F.regexp_replace(stem, r"(?U)\W+", "_"), "^_+|_+$", ""), 1, 30)
    return F.concat_ws("_", F.when(safe == "", "document").otherwise(safe), F.substring(F.md5(path.cast("binary")), 1, 12))


def selection_limit(question: Column, budget: Column | int, dynamic: bool = True) -> Column:
    """Passages to return: the budget, or 3 and up to 3 more by complexity."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    if not dynamic:
        return budget
    marks = sum((question.contains(m).cast("int") for m in COMPLEX_MARKERS), F.lit(0))
    asked = F.greatest(F.lit(0), F.size(F.regexp_extract_all(question, F.lit("([？?；;])"), F.lit(1))) - 1)
    return F.least(budget, 3 + F.least(marks + asked, F.lit(3)))


def keyword_ratio(terms: Column, normal_text: Column) -> Column:
    """Share of the (normalised) terms that the normalised text holds."""
    hits = F.size(F.filter(terms, lambda t: normal_text.contains(t)))
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def holds_all(tokens: Column, normal_text: Column) -> Column:
    """The exact-number guard: there are tokens and all are in the text."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: normal_text.contains(t))


def as_bool(text: str | None, default: bool = False) -> bool:
    return default if text is None else text.strip().lower() in {"1", "true", "yes", "on"}
