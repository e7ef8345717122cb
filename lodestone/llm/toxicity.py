"""Toxicity by weak supervision.

Many noisy voters say "toxic", "clean" or abstain: lexicon voters (a whole
word), pattern voters (words opening with a stem), both mined from a bounded
sample of labelled rows, a pattern voter that says "clean" of a text without
any mined toxic pattern, and the annotator, that is the sample's own labels.
A generative label model, fitted by expectation maximisation, estimates every
voter's accuracy, the annotator's included, and the voters' correlations, and
discounts voters that repeat each other.  Its posterior labels, which differ
from the annotator's where the other voters outvote them, train a logistic
classifier over the mined words and stems, which then scores every whole text
in one pass.

Only text enters a score.  Counting runs on the executors.  The one bound is
that of the sample, MOST_ROWS; what is mined from it is not cut off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import BoundedCache, bound_batches, filter_texts, map_texts, row_slices
from lodestone.llm.common import Workspace

#: The sample of labelled rows: the least hashes of their ids, so many at most.
MOST_ROWS = 20_000
LEAST_SUPPORT = 3
#: Every opening of a word from so many letters on is a stem; longer words have the first sixteen letters' stems.
SHORTEST_STEM, LONGEST_STEM = 3, 16
#: A mined pattern points to its class by this log odds ratio at least.
LEAST_ODDS = 2.0
#: Voters whose firing is correlated less are taken as independent.
LEAST_CORRELATION = 0.3
#: Where the annotator's rates of finding toxic and clean rows start; both are then estimated.
START = (0.9, 0.99)
#: Strength of the classifier's pull towards zero, in rows.
DECAY = 0.1
#: Voters whose pairs with all others are looked at together, and entries of a dense block of rows by voters.
VOTERS_AT_ONCE, ENTRIES_AT_ONCE = 2_048, 4_000_000
#: Bytes that the words of a worker's cache take at most, and what an entry takes besides its text.
CACHED_BYTES, ENTRY_BYTES = 50_000_000, 200
#: Bytes of text whose features are counted before the counts leave the worker.
COUNTED_AT_ONCE = 1_000_000
WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word itself and its stems (marked by a trailing asterisk)."""
    return [word, *(word[:n] + "*" for n in range(SHORTEST_STEM, min(len(word), LONGEST_STEM) + 1))]


def text_features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features(w)}


class Matcher:
    """Finds which of the given features a text holds."""

    def __init__(self, known: dict[str, int]):
        self.known, self.hits = known, BoundedCache(CACHED_BYTES)

    def __call__(self, text: str) -> set[int]:
        found: set[int] = set()
        hits, known = self.hits, self.known
        words = set(WORD.findall(text.lower()))
        for word in words:
            ids = hits.get(word)
            if ids is None:
                ids = hits[word] = tuple(known[f] for f in features(word) if f in known)
                hits.weight += ENTRY_BYTES + 4 * len(word)
            if ids:
                found.update(ids)
        hits.make_room()
        return found


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(toxic, text) of at most ``most`` labelled rows that are not held out."""
    named = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    named = named.filter(~held_out("id")).groupBy("id").agg(F.max("toxic").alias("toxic"))
    sample = named.orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(sample), "id").select("toxic", "text")


def _counted(rows: DataFrame, known: dict[str, int] | None) -> DataFrame:
    """(feature, toxic, n): rows that hold each feature, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(known) if known is not None else None
        names = list(known) if known is not None else None
        for part, texts in (x for batch in batches for x in row_slices(batch, 1, COUNTED_AT_ONCE)):
            counts: Counter = Counter()
            for toxic, text in zip(part.column(0).to_pylist(), texts, strict=True):
                counts.update((names[i], toxic) for i in match(text)) if match else counts.update((f, toxic) for f in text_features(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["feature", "toxic", "n"])

    return rows.select("toxic", "text").mapInArrow(run, "feature string, toxic int, n long").groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def _tail(n: int, hits: int, share: float) -> float:
    """Log chance of at least ``hits`` of n by a coin of that share (a bound by relative entropy)."""
    p = hits / n
    if p <= share:
        return 0.0
    far = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
    return -n * far


def select(names: list[str], counts: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Numbers of the features that point to toxic and to clean rows.

    ``counts`` has a row (toxic, clean) for each feature, ``sizes`` the rows
    of either class.  A feature stays if its odds ratio is large and if less
    than one feature of so many would be expected to do as well by chance.
    """
    n, share = counts.sum(axis=1), sizes / max(1.0, sizes.sum())
    rate = (counts + 0.5) / (sizes + 1.0)
    odds = np.log(rate[:, 0]) - np.log(rate[:, 1])
    rare, out = -math.log(max(2, len(names))), ([], [])
    for i in np.flatnonzero((np.abs(odds) >= LEAST_ODDS) & (n >= LEAST_SUPPORT)):
        side = int(odds[i] < 0)
        if 0 < share[side] < 1 and _tail(int(n[i]), int(counts[i, side]), float(share[side])) <= rare:
            out[side].append(int(i))
    return out


def mine(rows: DataFrame) -> tuple[list[str], int]:
    """Features that point to a class: (those of toxic rows, then of clean rows; how many of the first)."""
    sizes = np.array(_class_sizes(rows), dtype=float)
    if not sizes.all():
        return [], 0
    # What stands in fewer toxic rows than LEAST_SUPPORT can only point to clean ones, and only if it is
    # common there: both kinds are chosen on the executors before anything is gathered.
    toxic = _counted(rows.filter("toxic = 1"), None).select("feature", F.col("n").alias("t")).filter(F.col("t") >= LEAST_SUPPORT)
    names = sorted(toxic.select("feature").toArrow()["feature"].to_pylist())
    known = {f: i for i, f in enumerate(names)}
    counts = np.zeros((len(names), 2))
    if names:
        for part in _counted(rows, known).toArrow().to_batches():
            own, toxic_rows, n = (part.column(c) for c in ("feature", "toxic", "n"))
            counts[[known[f] for f in own.to_pylist()], 1 - toxic_rows.to_numpy()] = n.to_numpy()
    to_toxic, to_clean = select(names, counts, sizes)
    return [names[i] for i in [*to_toxic, *to_clean]], len(to_toxic)


def _class_sizes(rows: DataFrame) -> tuple[int, int]:
    found = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    return found.get(1, 0), found.get(0, 0)


def distinct_voters(hits: list[list[int]], toxic: int) -> list[int]:
    """Of features that fire on the same rows, the first of the shortest.

    They are one voter: a word and all stems that only it has.  ``toxic``
    features say toxic, later ones clean; the two kinds never merge.
    """
    where: dict[int, list[int]] = {}
    for row, found in enumerate(hits):
        for j in map(int, found):
            where.setdefault(j, []).append(row)
    first: dict[tuple, int] = {}
    for j in sorted(where):
        first.setdefault((j < toxic, tuple(where[j])), j)
    return sorted(first.values())


def calibrate(sums: np.ndarray, target: np.ndarray, start: np.ndarray, steps: int = 20, pull: float = 1.0) -> np.ndarray:
    """Scale (positive) and offset that make sums of votes log odds of the target, by Newton steps that never lose ground."""
    x = np.stack([sums, np.ones(len(sums))], axis=1)
    home = np.array([1.0, 0.0])

    def loss(by: np.ndarray) -> float:
        z = x @ by
        return float((np.logaddexp(0, z) - target * z).sum() + pull / 2 * (by[0] - 1) ** 2)

    best, least = start, loss(start)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ best, -30, 30)))
        slope = x.T @ (p - target) + pull * (best - home) * (1, 0)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([pull, 1e-6])
        step = np.linalg.solve(curve, slope)
        for _ in range(30):
            new = best - step
            if new[0] > 0 and (now := loss(new)) < least:
                break
            step = step / 2
        else:
            return best
        best, least = new, now
    return best


class Firings:
    """Which voters fire on which rows, as dense blocks of rows by voters.

    Blocks hold ENTRIES_AT_ONCE entries, so memory does not grow with the
    hits of a row, and pairs of voters are counted by products of blocks, for
    VOTERS_AT_ONCE voters against all at a time.
    """

    def __init__(self, rows: np.ndarray, voters: np.ndarray, n: int, v: int):
        self.rows, self.voters, self.n, self.v = rows, voters, n, v  # sorted by row
        self.step = max(1, ENTRIES_AT_ONCE // max(1, v))
        self.columns = [(a, min(a + VOTERS_AT_ONCE, v)) for a in range(0, v, VOTERS_AT_ONCE)]
        self.cached: np.ndarray | None = None

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first hit, end of the hits, their rows and voters as zeros and ones)."""
        for first in range(0, self.n, self.step):
            i, j = np.searchsorted(self.rows, (first, first + self.step))
            if i < j:
                dense = np.zeros((min(self.step, self.n - first), self.v), dtype=np.float32)
                dense[self.rows[i:j] - first, self.voters[i:j]] = 1
                yield int(i), int(j), dense

    def together(self, a: int, b: int) -> np.ndarray:
        """Rows on which each voter and each of the voters a to b - 1 both fire."""
        if self.cached is not None:
            return self.cached
        found = np.zeros((self.v, b - a), dtype=np.float32)  # whole numbers up to 2 ** 24 are exact
        for _, _, dense in self.blocks():
            found += dense.T @ dense[:, a:b]
        if len(self.columns) == 1:
            self.cached = found
        return found

    def crowd(self, near: np.ndarray, a: int, b: int, out: np.ndarray) -> None:
        """Puts for each hit of a voter a to b - 1 the sum of ``near`` over the voters that fire on its row."""
        for i, j, dense in self.blocks():
            own = np.flatnonzero((self.voters[i:j] >= a) & (self.voters[i:j] < b)) + i
            out[own] = (dense @ near)[self.rows[own] - self.rows[i] // self.step * self.step, self.voters[own] - a]


class Correlations:
    """Correlation of each pair of voters that fire on a common row, by (lower, higher) number."""

    def __init__(self, v: int):
        self.v, self.codes, self.values = v, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)

    def add(self, a: np.ndarray, b: np.ndarray, values: np.ndarray) -> None:
        codes = np.concatenate((self.codes, a * self.v + b))
        order = np.argsort(codes)
        self.codes, self.values = codes[order], np.concatenate((self.values, values.astype(np.float32)))[order]

    def __getitem__(self, pair: tuple[int, int]) -> float:
        code = pair[0] * self.v + pair[1]
        at = int(np.searchsorted(self.codes, code))
        if at == len(self.codes) or self.codes[at] != code:
            raise KeyError(pair)
        return float(self.values[at])

    def __len__(self) -> int:
        return len(self.codes)


def label_model(rows: np.ndarray, voters: np.ndarray, sides: np.ndarray, labels: np.ndarray, rounds: int = 50) -> dict:
    """Posterior labels from voters that speak up or abstain, and an annotator who labels every row.

    ``rows`` and ``voters`` list who fires where; ``sides`` is 1 for voters
    that say toxic, 0 for clean.  Accuracy of a voter: the chance that a row
    is of its side where it fires.  Correlation: of two voters' firing within
    a class, over both classes.  On a row a voter weighs one over one plus the
    sum of its correlations, of LEAST_CORRELATION or more, with those that fire
    there too, so that a family of voters counts about once.  The annotator's rates of finding toxic and clean rows
    are estimated too, against what the other voters say together, which is
    calibrated to the posterior first.
    """
    n, v = len(labels), len(sides)
    if not n:
        return {"posterior": np.zeros(0), "accuracy": np.full(v, 0.5), "correlation": Correlations(v), "weight": np.ones(v), "annotator": START}
    mine_of = np.bincount(voters, minlength=v)
    order = np.lexsort((voters, rows))
    by_row, by_voter = rows[order], voters[order]
    fire = Firings(by_row, by_voter, n, v)
    prior = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    post = np.where(labels == 1, *(prior * a / (prior * a + (1 - prior) * b) for a, b in ((START[0], 1 - START[1]), (1 - START[0], START[1]))))
    scale_of = np.array([1.0, math.log(prior / (1 - prior))])
    for _ in range(rounds):
        share = (max(post.sum(), 1e-9), max((1 - post).sum(), 1e-9))
        fired = np.bincount(voters, post[rows], minlength=v)
        right_of = np.where(sides == 1, fired, mine_of - fired)
        accuracy = np.clip((right_of + 1) / (mine_of + 2), 0.02, 0.98)
        means = (fired / share[0], (mine_of - fired) / share[1])
        scale = np.sqrt(np.maximum(sum(s * (m - m * m) for s, m in zip(share, means, strict=True)), 1e-9))
        crowd, correlation = np.zeros(len(by_row)), Correlations(v)
        for a, b in fire.columns:
            # Only voters that fire on a common row can be positively correlated; a row counts once over both classes.
            both = fire.together(a, b)
            near = both.astype(float)
            for s, m in zip(share, means, strict=True):
                near -= np.outer(s * m, m[a:b])
            near = np.clip(near / np.outer(scale, scale[a:b]), -1, 1)
            held = both > 0
            held[np.arange(a, b), np.arange(b - a)] = False
            close = held & (near >= LEAST_CORRELATION)
            left, right = np.nonzero(np.triu(held if len(fire.columns) == 1 else close, 1 - a))
            correlation.add(left, right + a, near[left, right])
            fire.crowd(np.where(close, near, 0).astype(np.float32), a, b, crowd)
        weight = 1 / (1 + crowd)
        # A voter's word is evidence beyond the prior: its accuracy against the share of its side.
        base = np.where(sides == 1, prior, 1 - prior)
        says = np.where(sides == 1, 1, -1) * (np.log(accuracy / (1 - accuracy)) - np.log(base / (1 - base)))
        said_by_all = np.bincount(by_row, weight * says[by_voter], minlength=n)
        scale_of = calibrate(said_by_all, post, scale_of)
        z = np.clip(scale_of[0] * said_by_all + scale_of[1], -30, 30)
        # The annotator is held against what the others say alone, so that no label vouches for itself.
        others = 1 / (1 + np.exp(-z))
        finds = float(np.clip((others[labels == 1].sum() + 1) / (others.sum() + 2), 0.5, 0.999))
        clears = float(np.clip(((1 - others)[labels == 0].sum() + 1) / ((1 - others).sum() + 2), 0.5, 0.999))
        said = np.where(labels == 1, math.log(finds / (1 - clears)), math.log((1 - finds) / clears))
        new = 1 / (1 + np.exp(-np.clip(z + said, -30, 30)))
        prior = min(max(new.mean(), 1e-3), 1 - 1e-3)
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return {"posterior": post, "accuracy": accuracy, "correlation": correlation, "weight": np.bincount(by_voter, weight, minlength=v) / np.maximum(1, mine_of), "annotator": (finds, clears)}


def _flat(hits: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every hit."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    return rows, np.concatenate([np.zeros(0, dtype=np.int64), *hits]).astype(np.int64)


def fit_classifier(hits: list[list[int]], target: np.ndarray, n_features: int, rounds: int = 300, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets: steps scaled by a bound of each feature's curvature, accelerated."""
    rows, cols = _flat(hits)
    each = np.bincount(rows, minlength=len(hits)) + 1.0
    bound = np.append(np.bincount(cols, each[rows], minlength=n_features), each.sum()) / 4 + decay
    w = ahead = np.zeros(n_features + 1)
    for k in range(rounds):
        z = ahead[-1] + np.bincount(rows, ahead[:-1][cols], minlength=len(hits))
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        slope = np.append(np.bincount(cols, gap[rows], minlength=n_features) + decay * ahead[:-1], gap.sum())
        before, w = w, ahead - slope / bound
        ahead = w + k / (k + 3) * (w - before)
    return w[:-1], float(w[-1])


def fit(hits: list[list[int]], labels: np.ndarray, n_features: int, toxic: int) -> dict:
    """The label model and the classifier, from the features that each labelled row holds.

    The first ``toxic`` of the features say toxic, the others clean.  One
    voter more says clean of rows without any that says toxic.
    """
    voters = distinct_voters(hits, toxic)
    number = np.full(n_features, -1)
    number[voters] = np.arange(len(voters))
    sides = np.array([*(int(j < toxic) for j in voters), 0])
    rows, cols = _flat(hits)
    votes = number[cols] >= 0
    quiet = np.flatnonzero(np.bincount(rows[cols < toxic], minlength=len(hits)) == 0)
    model = label_model(np.append(rows[votes], quiet), np.append(number[cols[votes]], np.full(len(quiet), len(voters))), sides, labels)
    weights, bias = fit_classifier(hits, model["posterior"], n_features) if len(hits) else (np.zeros(0), -2.0)
    return {"weights": weights, "bias": bias, "label_model": model, "voters": voters}


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> dict:
    """Mined features, the label model, and the classifier's weights."""
    bound_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "toxicity")
    rows = work.save(training_rows(docs, labels, id_col, text_col, most_rows), "sample")
    names, toxic = mine(rows)
    known = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(known)
        for part, texts in (x for batch in batches for x in row_slices(batch, 1)):
            hits = [sorted(match(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hits, pa.list_(pa.int32()))], names=["toxic", "hits"])

    parts = rows.mapInArrow(run, "toxic int, hits array<int>").toArrow().to_batches()
    got = [(t, h.values.to_numpy()) for p in parts for t, h in zip(p.column(0).to_pylist(), p.column(1), strict=True)]
    got.sort(key=lambda x: (x[0], x[1].tobytes()))
    work.drop("sample")
    return {"features": names, "toxic": toxic} | fit([h for _, h in got], np.array([t for t, _ in got]), len(names), toxic)


class Scorer:
    """Scores (0 to 1) of texts; empty ones have the bias only."""

    def __init__(self, model: dict):
        self.known = {f: i for i, f in enumerate(model["features"])}
        self.weights, self.bias, self.match = model["weights"].tolist(), model["bias"], None

    def __call__(self, texts: list[str]) -> list[float]:
        self.match = self.match or Matcher(self.known)
        sums = [self.bias + math.fsum(self.weights[i] for i in self.match(t)) for t in texts]
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in sums]


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    score = Scorer(model)
    return map_texts(docs, id_col, text_col, {"score": ("double", pa.float64())}, lambda texts: [score(texts)])


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that ``toxicity`` predicts toxic; all columns stay."""
    score = Scorer(learn(docs, labels, id_col, text_col))
    return filter_texts(docs, text_col, lambda texts: [s < 0.5 for s in score(texts)])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Labels are learned from rows that are not held out (crc32 of the id as
    text, modulo 5, is not 0); ids, languages and sources never enter a score.
    Without any usable label every score is the same, below one half.  Null
    text counts as empty; repeated rows are each scored; a null id is not held
    out; extra columns are ignored.
    """
    scored = score_texts(docs, learn(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
