import random
import re

from lodestone.llm.line_dedup import delete_repeats


def plain(docs, least):
    """Longest earlier run from every line, by comparing with all earlier lines."""
    lines = [(i, t.split("\n")) for i, t in sorted(docs)]
    places, out = {}, {}
    for d, (_, own) in enumerate(lines):
        for p, line in enumerate(own):
            places.setdefault(line, []).append((d, p))
    for d, (i, own) in enumerate(lines):
        runs, reach = [], 0
        for p in range(len(own)):
            best = 0
            for e, o in places[own[p]]:
                if (e, o) >= (d, p):
                    break
                n, other = 0, lines[e][1]
                while p + n < len(own) and o + n < len(other) and other[o + n] == own[p + n]:
                    n += 1
                best = max(best, n)
            if best and p + best > reach:
                reach = p + best
                if sum(len(re.findall(r"\S+", x, re.ASCII)) for x in own[p : p + best]) >= least:
                    runs.append((p, best))
        out[i] = runs, "\n".join(x for n, x in enumerate(own) if not any(a <= n < a + b for a, b in runs))
    return out


def run(spark, docs, least):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r.doc_id: ([tuple(x) for x in r.line_runs], r.text) for r in delete_repeats(df, min_words=least).collect()}


def test_random_lines(spark):
    for seed, least in ((0, 1), (1, 4), (2, 9)):
        rng = random.Random(seed)
        docs = [(i, "\n".join(rng.choice(["a b", "c", "d e f", "g", ""]) for _ in range(rng.randint(1, 30)))) for i in range(25)]
        assert run(spark, docs, least) == plain(docs, least)


def test_long_passage_in_the_middle_and_hot_short_lines(spark):
    passage = "\n".join(f"line {n} of the passage with some words" for n in range(8))
    docs = [(i, f"start {i}\nhot\n{passage if i in (3, 9, 17) else 'own ' + str(i)}\nend {i}\nhot") for i in range(40)]
    got = run(spark, docs, 50)
    assert got == plain(docs, 50)
    assert {i for i, (runs, _) in got.items() if runs} == {9, 17}


def test_one_line_repeated_in_its_own_document(spark):
    docs = [(1, "\n".join(["ten words " * 5] * 9)), (2, "\n" * 50)]
    assert run(spark, docs, 30) == plain(docs, 30)


def test_edge_rows(spark):
    text = "w " * 60
    rows = [(1, text, 5, "a"), (1, text, 5, "a"), (2, None, 6, "b"), (None, text, 7, "c"), (3, "", 8, "d"), (4, text + "\nx", 9, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int, runs string")
    out = delete_repeats(df)
    assert out.columns == ["doc_id", "text", "uid", "runs", "line_runs"]
    got = sorted(((r.doc_id, r.text, r.uid) for r in out.collect()), key=str)
    # The null id comes first and keeps its copy; both rows of document 1 change alike.
    assert got == sorted([(1, "", 5), (1, "", 5), (2, None, 6), (None, text, 7), (3, "", 8), (4, "x", 9)], key=str)
    assert delete_repeats(df.limit(0)).collect() == []
