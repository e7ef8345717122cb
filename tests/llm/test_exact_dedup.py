import hashlib
import random

from lodestone.llm.radix_dedup import digit_width, exact_duplicates


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        known = [x for x in groups[t or ""] if x is not None]
        keep = max(known) if known else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, extra=""):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, gid int, rest string")
    return sorted((tuple(r) for r in exact_duplicates(df).collect()), key=str)


def test_random_texts_with_long_shared_prefixes(spark):
    rng = random.Random(4)
    stems = ["", "a", "ab" * 40, "é" * 700, "x" * 17000, "x" * 17000 + "y"]
    rows = [(i, rng.choice(stems) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3)))) for i in range(300)]
    assert run(spark, rows) == plain(rows)


def test_nulls_empty_ties_and_repeats(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (4, "A"), (5, "a ")]
    assert run(spark, rows) == plain(rows)


def test_texts_that_end_on_a_digit_edge(spark):
    edge = digit_width(0)
    rows = [(n, "z" * (edge + d)) for n, d in enumerate([-1, 0, 1, -1, 0, 1, 0])]
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_many_copies_of_one_text(spark):
    rows = [(i, "copy " * 300 if i % 3 else f"own {i}") for i in range(900)]
    assert run(spark, rows) == plain(rows)
