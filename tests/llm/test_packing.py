"""Packing: every id once, sequences without gaps, little padding, ids as the tokenizer library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestone.llm.packing import Encoder, Packer, difference, pack, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")


def padding(sizes, capacity=1024):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


def held_to_the_contract(rows, docs, capacity=1024):
    """docs: the ids of each document, by id; rows: (id, start, length, crc, total, sequence, offset)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r)
        by_sequence[r[5]].append((r[6], r[2]))
    assert by_doc.keys() == docs.keys()
    for doc, found in by_doc.items():
        at, ids = 0, docs[doc]
        for _, start, length, crc, total, _, _ in sorted(found, key=lambda r: r[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes())
            at += length
        assert at == len(ids)
    sizes = []
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


def test_difference_is_near_equal_and_complete():
    draw = random.Random(3)
    for _ in range(30):
        k, sizes = draw.randrange(1, 12), [draw.randrange(1, 129) for _ in range(draw.randrange(1, 200))]
        found = difference(sizes, k)
        loads = np.bincount(found, sizes, minlength=k)
        assert len(found) == len(sizes) and found.min() >= 0 and found.max() < k and loads.sum() == sum(sizes)
        if len(sizes) > 12 * k:
            assert loads.max() - loads.min() <= max(sizes) / 4


def test_differencing_of_two_is_the_textbook_one():
    assert sorted(np.bincount(difference([8, 7, 6, 5, 4], 2), [8, 7, 6, 5, 4]).tolist()) == [14, 16]


def test_window_count_rises_where_capacity_is_exceeded():
    sizes = [6, 6, 6, 6]  # 24 ids would need two windows of 12, or three of 11
    assert np.bincount(windows(sizes, 12), sizes).tolist() == [12, 12]
    assert max(np.bincount(windows(sizes, 11), sizes)) <= 11 and len(np.bincount(windows(sizes, 11))) == 4


@pytest.mark.parametrize("capacity", [16, 1000, 1024])
def test_packer_keeps_every_id_once(capacity):
    draw, packer, docs = random.Random(9), Packer(capacity, 5), {}
    for doc in range(400):
        n = draw.choice([1, 2, draw.randrange(1, 300), draw.randrange(1, 5 * capacity), capacity, 3 * capacity])
        docs[doc] = np.array([draw.randrange(50_000) for _ in range(n)], dtype=np.uint32)
        packer.add((doc,), docs[doc])
    packer.finish()
    rows = [(d[0], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset) for d, start, ids, total, sequence, offset in packer.rows]
    sizes = held_to_the_contract(rows, docs, capacity)
    assert padding(sizes, capacity) <= (0.02 if capacity > 100 else 0.15) * sum(sizes)


def test_whole_contract_over_rows(spark):
    own = Tokenizer.from_file(PATH)
    draw = random.Random(2)
    words = ["alpha", "Beta's", " ", "\n\n", "é", "中文字", "123", "😀", "<|endoftext|>", "a" * 40, "  "]
    texts = {i: " ".join(draw.choices(words, k=draw.choice([1, 5, 50, 700]))) for i in range(300)}
    texts |= {900: None, 901: "", 902: "x" * 200_000, 903: "word " * 60_000, 904: "<|endoftext|>"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    got = pack(docs, PATH, with_ids=True)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = got.collect()
    sizes = held_to_the_contract([tuple(r)[:7] for r in rows], want)
    assert padding(sizes) < 0.01 * sum(sizes)
    assert all(r.ids == want[r.doc_id][r.start : r.start + r.length] for r in rows)


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [(None, "one two", 1, 2), (None, "one two", 1, 2), (7, "same", 3, 4), (7, "same", 3, 4), (8, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, offset long").coalesce(1)
    got = pack(docs, PATH).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2 + 2 + 1
    assert sorted(r.doc_tokens for r in got if r.start == 0) == [1, 2, 2, 3, 3]
    assert pack(docs.limit(0), PATH).collect() == []


def test_ids_equal_the_library(spark):
    own, encode, draw = Tokenizer.from_file(PATH), Encoder(PATH), random.Random(4)
    assert encode.fast is not None
    parts = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "'s", "'S", "é", "1", "२", "中", "😀", "‍", "\x85", "\xa0", "　", "\x1c", "\r\n", "ẞ", "﻿", "ing", " the"]
    for _ in range(3_000):
        text = "".join(draw.choices(parts, k=draw.randrange(60)))
        assert encode(text) == own.encode(text, add_special_tokens=False).ids
    for text in (" " * 1_000_000, "\n" * 300_000 + "x", "a" * 300_000):  # beyond what the fast library takes, too
        assert encode(text) == own.encode(text, add_special_tokens=False).ids


def test_other_tokenizer_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = Encoder(path)
    assert encode.fast is None
    assert encode("Some Words") == Tokenizer.from_file(path).encode("Some Words", add_special_tokens=False).ids
