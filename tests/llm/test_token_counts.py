import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lodestone.llm import cuts, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(library, texts):
    assert token_counts.count_texts(texts, PATH) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_random_texts(library):
    rng = random.Random(2)
    letters = " \n▁ab<s/>thé\u0000中\U0001f600\r\te 0x　"
    same(library, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(5000)])


def test_spaces_and_long_runs(library):
    texts = [" " * n + "x" + " " * k for n in range(0, 40, 3) for k in (0, 1, 5, 18)]
    same(library, texts + ["a" * n for n in range(0, 600, 13)] + ["the" * 300, " " * 700, "中" * 300, "banana" * 500, "<s></s><unk><0x0A>"])


def test_unspaced_texts(library):
    rng = random.Random(4)
    han = "".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(100_000))
    often = "".join(rng.choice("的一是不了在人有我他这个们中来上大为和国地到以说时") for _ in range(50_000))
    latin = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    few = "".join(rng.choice(["the", "and", "ing", "er"]) for _ in range(30_000))
    same(library, [han, often, latin, few, "a" * 300_000, "ab" * 100_000, "=" * 70_001])


def test_caches_are_bounded_in_bytes(library):
    """Unspaced texts are words of thousands of characters: none of them stays."""
    rng = random.Random(11)
    texts = ["".join(chr(rng.randint(0x4E00, 0x6000)) for _ in range(1_000)) for _ in range(200)]
    token_counts.load.cache_clear()
    same(library, texts + ["short words stay " * 3])
    _, marked, bare = token_counts.load(PATH)
    assert max(map(len, [*marked, *bare])) <= token_counts.LONGEST_KEPT and "stay" in marked
    assert marked.weight == sum(token_counts.ENTRY_BYTES + 4 * len(w) for w in marked)


def test_cuts_are_where_no_entry_reaches_across():
    rng = random.Random(9)
    entries = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(12)]
    known = cuts.Vocabulary([np.array([ord(c) for c in x], dtype=np.uint32) for x in entries])
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 30)))
        crossed = {i + k for x in entries for i in range(len(text)) if text.startswith(x, i) for k in range(1, len(x))}
        got = known.cuts(np.array([ord(c) for c in text], dtype=np.uint32)).tolist()
        assert got == [i for i in range(1, len(text)) if i not in crossed]


def test_rows(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, ""), (3, None), (None, "x " * 5000)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted(map(tuple, token_counts.token_counts(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(df.limit(0), PATH).collect() == []
