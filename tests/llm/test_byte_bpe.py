import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lodestone.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def same(codec, library, texts):
    ids = codec.encode(texts)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert codec.decode(ids) == [t.encode() for t in texts]


def test_long_words_of_many_kinds(codec, library):
    rng = random.Random(8)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    latin = "abcdefghijklmnopqrstuvwxyz"
    words = " ".join(draw(latin, 2000) for _ in range(500))
    han = "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(60_000))
    same(codec, library, [words, han, draw("abcdeth", 30_000), draw(["the", "and", "ing", "er"], 20_000), "ab" * 50_000, "=" * 70_001, "a" * 200_000])


def test_words_too_long_for_a_query(codec, library, monkeypatch):
    """The array form of the recursion, on all words of over 33 bytes and on one of 16 MB."""
    whole = "a" * 16_000_000
    same(codec, library, [whole[:1_000_001]])
    ids = np.frombuffer(codec.encode([whole])[0], dtype="<u4")
    some = np.frombuffer(codec.encode([whole[:1_600_000]])[0], dtype="<u4")
    assert np.array_equal(ids[: len(some) // 2], some[: len(some) // 2]) and codec.decode([ids.tobytes()]) == [whole.encode()]
    monkeypatch.setattr(byte_bpe, "MOST_QUERIED", byte_bpe.LONG)
    rng = random.Random(18)
    draw = lambda parts, n: "".join(rng.choice(parts) for _ in range(n))
    codec.words.clear()
    for parts in ("ab", "abcdeth", ["the", "and", "ing", "er"], "=-", "aä", "的一是不了", "eeeea", ["  ", "\n"], "\U0001f600\U0001f601"):
        same(codec, library, [draw(parts, rng.randrange(40, 3_000)) for _ in range(40)])


def test_random_texts(codec, library):
    rng = random.Random(1)
    letters = " \n'sab<|endoftext|>thé\u0000中\U0001f600\r\te 0x19²ſ\x1c\xa0"
    same(codec, library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)])


def test_long_words(codec, library):
    same(codec, library, ["a" * 5000, "abc" * 900, " " * 3000, "ä" * 1500, "\n" * 60, "x" * byte_bpe.LONG, "x" * (byte_bpe.LONG + 1)])


def test_every_latin_character_in_context(codec, library):
    same(codec, library, [f"a {chr(c)}b{chr(c)} 1{chr(c)}" for c in range(0x300)])


def test_caches_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(codec.words, "most", 3)
    monkeypatch.setattr(codec.runs, "most", 3)
    for _ in range(3):
        same(codec, library, ["one two three four", "five six seven eight"])


def test_words_of_few_texts_are_held_at_once(codec):
    """3.9 million characters took 49 MB as words of one slice."""
    draw = random.Random(41)
    texts = [" ".join(draw.choices(["the", "of", "river", "stone", "light", "and"], k=20_000)) for _ in range(40)]
    codec.words.clear()
    codec.runs.clear()
    tracemalloc.start()
    try:
        counts, ids, decoded = byte_bpe.digests(texts, PATH, public_tokenizers.PATTERN)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 30_000_000 and len(counts) == len(ids) == 40 and decoded == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_rows(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "x")]
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, ids string")
    got = byte_bpe.round_trip(df, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(got) == 5
    for r in got:
        raw = np.array(r.ids, dtype="<u4").tobytes()
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(raw).hexdigest()
    assert {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}
    assert byte_bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []
