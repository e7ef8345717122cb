"""All five profiles, topics and structure against plain loops over one small corpus."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.embedding import deterministic, embed_text
from lodestone.functions.text import COMPLEX_MARKERS
from lodestone.operators import graph, profiles, topics

WORDS = "alpha beta gamma delta revenue profit section ratio alphabet 2024 12.5 7 1,234 betas".split()


def corpus(seed):
    draw = random.Random(seed)
    chunks = [(f"d{d}::{s}", f"d{d}", s, " ".join(draw.choices(WORDS, k=draw.randint(3, 9)))) for d in range(4) for s in range(5)]
    asked = [(q, " ".join(draw.choices(WORDS, k=draw.randint(1, 4))) + draw.choice(["", "?", "? ; ?", " 原因"])) for q in range(6)]
    return chunks, asked


def normal(text):
    value = re.sub(r"(?<=\d),(?=\d{3}(?:\D|$))", "", text.lower())
    value = re.sub(r"[\s,;:，；：]+", "", value)
    return re.sub(r"(?<!\d)\.|\.(?!\d)", "", value)


def concepts(text, most=6):
    found = re.findall(r"[一-鿿]{2,12}|[A-Za-z][A-Za-z0-9_-]{1,23}", text)
    return sorted(dict.fromkeys(found), key=lambda c: (-found.count(c), found.index(c)))[:most]


def terms(question):
    value = normal(question)
    han = re.sub(r"[^一-鿿]", "", value)
    return list(dict.fromkeys([*re.findall(r"[a-z0-9_-]{2,}", value), *(han[i : i + 2] for i in range(len(han) - 1)), *concepts(question)]))


def clusters(vectors):
    """Leader clustering in order: {cluster: members}."""
    found = []
    for i, v in enumerate(vectors):
        near = [(float(np.dot(np.mean([vectors[j] for j in c], axis=0), v) / np.linalg.norm(np.mean([vectors[j] for j in c], axis=0))), -n) for n, c in enumerate(found)]
        best = max(near, default=(-1, 0))
        if best[0] >= topics.SIMILARITY:
            found[-best[1]].append(i)
        else:
            found.append([i])
    return found


def plain(profile, chunks, question, budget):
    use, score = profiles.PROFILES[profile], {}
    asked = embed_text(question)
    vector = sorted(((round(float(asked @ embed_text(t)), 9), c) for c, _, _, t in chunks), key=lambda x: (-x[0], x[1]))[:4]
    for s, c in vector:
        score[c] = 0.70 * s
    add = lambda c, s: score.__setitem__(c, score.get(c, 0.0) + s)
    wanted = [normal(t) for t in terms(question)]
    own = {c: concepts(t) for c, _, _, t in chunks}
    if use.keyword and wanted:
        for c, _, _, t in chunks:
            held = sum(w in normal(t) for w in wanted)
            if held:
                add(c, 0.20 * held / len(wanted))
    touch = lambda a, b: a in b or b in a
    if use.graph:
        edges = {(a, b) for names in own.values() for a in names for b in names if a != b}
        nodes = {a for a, _ in edges}
        hit = {n for n in nodes if any(touch(t, n) for t in terms(question))}
        related = {*terms(question), *hit, *(b for a, b in edges if a in hit)}
        for c, names in own.items():
            n = sum(any(touch(t, x) for t in related) for x in names)
            if n:
                add(c, min(0.20, 0.07 * n))
    if use.topic:
        for doc in {d for _, d, _, _ in chunks}:
            mine = [(c, embed_text(t)) for c, d, _, t in chunks if d == doc]
            for members in clusters([v for _, v in mine]):
                centre = np.mean([mine[i][1] for i in members], axis=0)
                s = max(0.0, float(asked @ (centre / np.linalg.norm(centre)))) * 0.08
                for i in members:
                    add(mine[i][0], s)
    numbers = re.findall(r"\d+(?:\.\d+)?%?", normal(question))
    if use.exact and numbers:
        for c, _, _, t in chunks:
            if all(n in normal(t) for n in numbers):
                add(c, 0.18)
    if use.bridges:
        place = {(d, s): c for c, d, s, _ in chunks}
        where = {c: (d, s) for c, d, s, _ in chunks}
        before = dict(score)
        for c in sorted(before, key=lambda c: (-round(before[c], 12), c))[: max(budget, 2)]:
            for step in (-1, 1):
                near = place.get((where[c][0], where[c][1] + step))
                if near:
                    score[near] = max(score.get(near, 0.0), before[c] * 0.82)
    limit = budget
    if use.dynamic:
        marks = sum(m in question for m in COMPLEX_MARKERS) + max(0, len(re.findall("[？?；;]", question)) - 1)
        limit = min(budget, 3 + min(3, marks))
    return sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:limit]


@pytest.mark.parametrize("seed", [1, 2])
def test_profiles_equal_plain_scoring(spark, seed):
    chunks, asked = corpus(seed)
    embed = deterministic()
    rows = spark.createDataFrame(chunks, "chunk_id string, doc_id string, sequence int, clean_text string").withColumns({"embedding": embed(F.col("clean_text")), "chapter": F.lit("x")})
    own = graph.chunk_concepts(rows)
    named = own.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "concept"))).alias("c")).select("chunk_id", F.col("c.concept").alias("concepts"))
    found = topics.build_topics(rows.join(named, "chunk_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>"))))
    questions = spark.createDataFrame(asked, "query_id int, question string").withColumn("embedding", embed(F.col("question")))
    for profile in ("vector_topic_graph", "full"):
        got = {}
        for r in profiles.retrieve(profile, questions, rows, own, graph.concept_edges(own), found, 5, recall_k=4).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        for q, question in asked:
            want = plain(profile, chunks, question, 5)
            assert [c for c, _ in got.get(q, [])] == [c for c, _ in want], (profile, question)
            assert np.allclose([s for _, s in got.get(q, [])], [s for _, s in want], atol=1e-8)


def test_topics_equal_plain_clusters(spark):
    chunks, _ = corpus(5)
    rows = spark.createDataFrame(chunks, "chunk_id string, doc_id string, sequence int, clean_text string").withColumns({"embedding": deterministic()(F.col("clean_text")), "chapter": F.lit("x"), "concepts": F.array(F.col("chunk_id"))})
    got = {}
    for r in topics.build_topics(rows).orderBy("topic_id").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_ids)
    for doc in {d for _, d, _, _ in chunks}:
        mine = [(c, embed_text(t)) for c, d, _, t in chunks if d == doc]
        assert got[doc] == [[mine[i][0] for i in c] for c in clusters([v for _, v in mine])]
