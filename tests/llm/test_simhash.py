import random

import numpy as np
from xxhash import xxh64_intdigest

from lodestone.llm import simhash
from lodestone.llm.common import Workspace
from lodestone.llm.components import components


def plain_fingerprint(text):
    words = text.encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(8)
    texts = ["", " \t\n", "One", "one TWO", "a b c", "É é x", "a\x0bb\x0cc\rd\x1ce", "x y z w"] + [" ".join(rng.choice(["Foo", "bar", "é", "baz"]) for _ in range(n)) for n in range(1, 60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(200)]
    fps = set(base) | {0, 2**64 - 1, 7, 15}
    for b in base:
        for _ in range(4):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << bit
            fps.add(x)
    signed = np.array(list(fps), dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(min(x, y), max(x, y)) for i, x in enumerate(signed) for y in signed[i + 1 :] if ((x ^ y) & (2**64 - 1)).bit_count() <= 3}
    assert len(want) > 500
    for hot in (simhash.HOT_BUCKET, 3, 0):
        assert {(r.a, r.b) for r in simhash.links(df, Workspace(spark, "t"), hot).collect()} == want


def test_components(spark):
    rng = random.Random(2)
    for nodes, edges in ((50, 30), (200, 400), (1, 0)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(n, n + 1) for n in range(1000, 1040)] * (nodes == 50) + [(5000, n) for n in range(5001, 5300)] * (nodes == 200)
        got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long"), Workspace(spark, "t")).collect()}
        linked = {n for a, b in pairs if a != b for n in (a, b)}
        assert got == {n: r for n, r in roots(pairs, linked).items()}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(400)]
    docs, n = [], 0
    for _ in range(40):
        body = [rng.choice(words) for _ in range(900)]
        for _ in range(rng.randint(1, 5)):
            copy = list(body)
            copy[rng.randrange(900)] = rng.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    docs += [(n, ""), (n + 1, None), (n + 2, "  "), (None, "solo text here now"), (n + 3, "tie"), (n + 3, "tie")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    prints = {t or "": plain_fingerprint(t or "") for _, t in docs}
    assert all(int(r.fingerprint, 16) in prints.values() and len(r.fingerprint) == 16 for r in got)
    fps = sorted(set(prints.values()))
    up = roots([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3], fps)
    least = {}
    for i, t in docs:
        if i is not None:
            r = up[prints[t or ""]]
            least[r] = min(i, least.get(r, i))
    want = sorted(((i, least.get(up[prints[t or ""]])) for i, t in docs), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == want
    assert len({c for _, c in want}) < 0.7 * len(docs)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, c in want if i == c), key=str)
    assert simhash.near_duplicates(df.limit(0)).collect() == []
