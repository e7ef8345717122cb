import math
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    fine = [f"{a}{b}" for a in "bcdfghkl" for b in ("onda", "erin", "alto", "umi", "ast")]
    bad, stem = ["grimface", "rotlump", "scabby"], ["vilq", "murx"]
    rows, labels = [], []
    for n in range(1500):
        words = [rng.choice(fine) for _ in range(rng.randint(5, 80))]
        toxic = n % 6 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                insult = rng.choice(bad) if n % 12 else rng.choice(stem) + rng.choice(["a", "eno", "ito", "us", "ade"])
                words.insert(rng.randrange(len(words)), insult.title() if rng.random() < 0.3 else insult + ",")
        rows.append((n, " ".join(words), n % 7))
        if n % 3:
            labels.append((n, int(toxic)))
        elif n % 2 == 0:
            labels.append((n, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict((n, int(n % 6 == 0)) for n in range(1500))


def test_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 1500 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}


def test_labels_of_held_out_rows_are_not_read(spark, corpus):
    docs, labels, _ = corpus
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out("doc_id"), 1 - labels.toxic).otherwise(labels.toxic))
    before = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    after = {r.doc_id: r.score for r in toxicity.toxicity(docs, turned).collect()}
    assert before.keys() == after.keys() and all(abs(before[k] - after[k]) < 1e-9 for k in before)


def fired(votes):
    return np.nonzero(votes)


def plain_label_model(votes, sides, labels, rounds=50):
    """The same model row by row and voter by voter, in plain loops."""
    n, v = len(votes), len(sides)
    prior = min(max(sum(labels) / n, 1e-3), 1 - 1e-3)
    finds, clears = toxicity.START
    post = [prior * finds / (prior * finds + (1 - prior) * (1 - clears)) if y else prior * (1 - finds) / (prior * (1 - finds) + (1 - prior) * clears) for y in labels]
    scale = np.array([1.0, math.log(prior / (1 - prior))])
    for _ in range(rounds):
        accuracy, rate, variance = [], [], []
        mass = (sum(post), n - sum(post))
        for j in range(v):
            hits = [post[i] for i in range(n) if votes[i][j]]
            good = sum(hits) if sides[j] else len(hits) - sum(hits)
            accuracy.append(min(max((good + 1) / (len(hits) + 2), 0.02), 0.98))
            rate.append((sum(hits) / mass[0], (len(hits) - sum(hits)) / mass[1]))
            variance.append(max(sum(m * (r - r * r) for m, r in zip(mass, rate[j], strict=True)), 1e-9))
        correlation = [[0.0] * v for _ in range(v)]
        for j in range(v):
            for k in range(v):
                if j != k and any(votes[i][j] and votes[i][k] for i in range(n)):
                    both = [sum((post[i], 1 - post[i])[c] for i in range(n) if votes[i][j] and votes[i][k]) for c in (0, 1)]
                    shared = sum(both[c] - mass[c] * rate[j][c] * rate[k][c] for c in (0, 1))
                    c = min(max(shared / math.sqrt(variance[j] * variance[k]), -1), 1)
                    correlation[j][k] = c if c >= toxicity.LEAST_CORRELATION else 0.0
        sums = []
        for i in range(n):
            z = 0.0
            for j in range(v):
                if votes[i][j]:
                    base = prior if sides[j] else 1 - prior
                    word = math.log(accuracy[j] / (1 - accuracy[j])) - math.log(base / (1 - base))
                    z += (1 if sides[j] else -1) * word / (1 + sum(correlation[j][k] for k in range(v) if votes[i][k]))
            sums.append(z)
        scale = toxicity.calibrate(np.array(sums), np.array(post), scale)
        z = [min(max(scale[0] * x + scale[1], -30), 30) for x in sums]
        others = [1 / (1 + math.exp(-x)) for x in z]
        finds = min(max((sum(q for q, y in zip(others, labels, strict=True) if y) + 1) / (sum(others) + 2), 0.5), 0.999)
        clears = min(max((sum(1 - q for q, y in zip(others, labels, strict=True) if not y) + 1) / (n - sum(others) + 2), 0.5), 0.999)
        new = [1 / (1 + math.exp(-min(max(x + (math.log(finds / (1 - clears)) if y else math.log((1 - finds) / clears)), -30), 30))) for x, y in zip(z, labels, strict=True)]
        prior = min(max(sum(new) / n, 1e-3), 1 - 1e-3)
        far, post = max(abs(a - b) for a, b in zip(new, post, strict=True)), new
        if far < 1e-6:
            break
    return post, accuracy, (finds, clears)


def noisy_votes(n=4000, seed=0):
    """Truth, labels of which some are wrong, and votes: two that fire together, one alone, noise, one for clean."""
    rng = np.random.default_rng(seed)
    truth = rng.random(n) < 0.2
    right = (truth & (rng.random(n) < 0.7)) | (~truth & (rng.random(n) < 0.01))
    alone = (truth & (rng.random(n) < 0.6)) | (~truth & (rng.random(n) < 0.02))
    noise = rng.random(n) < 0.2
    none = ~(right | alone)
    labels = np.where(rng.random(n) < 0.05, ~truth, truth).astype(int)
    return truth, labels, np.stack([right, right, alone, noise, none], axis=1), np.array([1, 1, 1, 1, 0])


def test_label_model_finds_accuracy_and_correlation():
    truth, labels, votes, sides = noisy_votes()
    model = toxicity.label_model(*fired(votes), sides, labels)
    assert model["accuracy"][0] > 0.9 and model["accuracy"][3] < 0.4 and model["accuracy"][4] > 0.9
    assert model["correlation"][0, 1] > 0.95 and abs(model["correlation"][0, 3]) < 0.1
    assert model["weight"][0] < 0.55 and model["weight"][3] > 0.85
    assert 0.85 < model["annotator"][0] < 0.99 and 0.9 < model["annotator"][1] < 0.99


def test_label_model_corrects_wrong_labels():
    truth, labels, votes, sides = noisy_votes()
    post = toxicity.label_model(*fired(votes), sides, labels)["posterior"] > 0.5
    assert ((post != labels) & (labels != truth)).sum() > 50
    # Toxic rows on which nothing fires, about 90 here, cannot be told from clean rows with a wrong label.
    assert (post != truth).sum() < 0.75 * (labels != truth).sum()


def test_label_model_equals_plain_loops():
    _, labels, votes, sides = noisy_votes(300, 3)
    model = toxicity.label_model(*fired(votes), sides, labels)
    post, accuracy, annotator = plain_label_model(votes.tolist(), sides.tolist(), labels.tolist())
    assert np.allclose(model["posterior"], post, atol=1e-5) and np.allclose(model["accuracy"], accuracy, atol=1e-5) and np.allclose(model["annotator"], annotator, atol=1e-5)


def test_label_model_in_blocks_is_the_same(monkeypatch):
    _, labels, votes, sides = noisy_votes(300, 3)
    whole = toxicity.label_model(*fired(votes), sides, labels)
    monkeypatch.setattr(toxicity, "VOTERS_AT_ONCE", 2)
    monkeypatch.setattr(toxicity, "ENTRIES_AT_ONCE", 35)
    model = toxicity.label_model(*fired(votes), sides, labels)
    assert np.allclose(model["posterior"], whole["posterior"], atol=1e-6) and np.allclose(model["weight"], whole["weight"], atol=1e-6)
    assert abs(model["correlation"][0, 1] - whole["correlation"][0, 1]) < 1e-6 and len(whole["correlation"]) > len(model["correlation"])


def test_many_hits_a_row_stay_in_bounds():
    """150 of 3,000 voters on each of 6,000 rows: 67 million pairs, none of them held."""
    import tracemalloc

    rng = np.random.default_rng(1)
    rows, voters = np.repeat(np.arange(6_000), 150), np.concatenate([rng.choice(3_000, 150, replace=False) for _ in range(6_000)])
    tracemalloc.start()
    toxicity.label_model(rows, voters, np.ones(3_000, dtype=int), (rng.random(6_000) < 0.2).astype(int), rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6


def test_posteriors_teach_better_than_noisy_labels():
    """Ablation: the classifier on posteriors against the same one on the labels as they are."""
    rng = np.random.default_rng(5)
    truth = rng.random(3000) < 0.15
    hits = [sorted({int(j) for j in range(12) if rng.random() < (0.35 if t else 0.01)}) for t in truth]
    labels = np.where(rng.random(3000) < np.where(truth, 0.25, 0.04), ~truth, truth).astype(int)
    model = toxicity.fit(hits, labels, 12, 12)
    plain, bias = toxicity.fit_classifier(hits, labels.astype(float), 12)
    wrong = lambda w, b: sum((b + sum(w[j] for j in h) > 0) != t for h, t in zip(hits, truth, strict=True))
    assert wrong(model["weights"], model["bias"]) <= wrong(plain, bias) and ((model["label_model"]["posterior"] > 0.5) != labels).sum() > 30


def test_selection_keeps_no_chance_features():
    counts = np.zeros((10_000, 2))
    counts[:5] = [[40, 0], [3, 0], [20, 20], [1, 400], [6, 0]]  # of 10,000 rare features, some stand in three toxic rows by chance
    toxic, clean = toxicity.select([str(i) for i in range(10_000)], counts, np.array([300.0, 2700.0]))
    assert toxic == [0, 2, 4] and clean == [3]


def test_features_on_the_same_rows_are_one_voter():
    assert toxicity.distinct_voters([[0, 1, 3], [0, 1], [2, 3]], 3) == [0, 2, 3]


def test_edge_rows(spark, corpus):
    docs, labels, _ = corpus
    rows = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "grimface", 1)], "doc_id long, text string, score int")
    got = toxicity.toxicity(rows, labels).collect()
    assert len(got) == 4 and len({r.score for r in got if r.doc_id is not None}) == 1
    assert not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 1500 and {r.predicted for r in none} == {0}
