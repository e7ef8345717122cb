"""The corpus pipeline against plain versions of its stages, run one after the other in loops."""

import hashlib
import math
import random

import public_tokenizers
import tiktoken
from test_line_dedup import plain as plain_line_dedup
from test_simhash import plain_fingerprint, roots

import corpus_pipeline
from lodestone.llm import byte_bpe, toxicity

LONG_ROW = "doc_id long, text string, lang string, source string, n_chars long, score int, uid string, hits string"


def corpus():
    """(documents, labels, items): clean, toxic, repeating, nearly equal and leaking texts, nulls, empties and repeated rows."""
    draw = random.Random(31)
    made = [f"{a}{b}{c}" for a in ("kor", "bel", "tra", "min", "lo") for b in ("an", "el", "io", "us", "er") for c in ("ta", "ko", "ri", "mo", "la", "su")]
    line = lambda n: " ".join(draw.choice(made) for _ in range(n))
    text = lambda: "\n".join(line(draw.randint(12, 20)) for _ in range(draw.randint(5, 9)))
    items = [(n, line(30)) for n in range(8)]
    passage = "\n".join(line(15) for _ in range(5))  # 75 words that several documents share
    docs, labels = {}, []
    for n in range(240):
        body = text()
        if n % 4 == 1:
            body = body.replace(" ", f" {draw.choice(['grimface', 'rotlump', 'scabby'])} ", 2)
        elif n % 12 == 0:
            body += "\n" + passage
        elif n % 12 == 2:
            body += "\n" + items[n // 12 % 8][1]
        elif n % 12 == 3 and n > 12 and docs.get(n - 12):
            body = docs[n - 12]
        elif n % 12 == 6:
            head, _, tail = docs[n - 3].rpartition(" ")
            body = f"{head} {tail}x"
        docs[n] = body
        labels.append((n, int(n % 4 == 1)))
    return docs | {1000: None, 1001: "", 1002: "one line"}, labels, items


def chained(spark, rows, labels, items):
    """What each plain stage keeps: {id: text}."""
    frame = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(model["features"], model["weights"].tolist(), strict=True))
    score = lambda t: 1 / (1 + math.exp(-(model["bias"] + sum(weight.get(f, 0.0) for f in toxicity.text_features(t)))))
    kept = {i: t for i, t in rows.items() if score(t or "") < 0.5}
    stages = [dict(kept)]
    cut = plain_line_dedup([(i, t or "") for i, t in kept.items()], 50)
    kept = {i: (None if t is None else cut[i][1]) for i, t in kept.items()}
    stages.append(dict(kept))
    marks = {i: plain_fingerprint(t or "") for i, t in kept.items()}
    near = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 3]
    home = roots(near, kept)
    kept = {i: t for i, t in kept.items() if home[i] == i}
    stages.append(dict(kept))
    kept = {i: t for i, t in kept.items() if not any(x in " ".join((t or "").split()) for _, x in items)}
    stages.append(dict(kept))
    return stages


def written(spark, tmp_path, rows, labels, items):
    table = lambda data, kind, name: spark.createDataFrame(data, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    table([(i, t, "en", "s", len(t or ""), 7, "u", "h") for i, t in rows], LONG_ROW, "documents")
    table([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int", "labels")
    table(items, "item_id long, text string", "benchmark")
    return str(tmp_path)


def test_run_equals_the_plain_stages(spark, tmp_path):
    docs, labels, items = corpus()
    stages = chained(spark, docs, labels, items)
    sizes = [len(docs), *map(len, stages)]
    assert sizes[0] - sizes[1] >= 55 and sizes[2] > sizes[3] > sizes[4] > 0.5 * sizes[1] and stages[0] != stages[1]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, written(spark, tmp_path, docs.items(), labels, items)).collect()}
    assert got.keys() == stages[-1].keys()
    ranks = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, text in stages[-1].items():
        assert got[i].ids == library.encode_ordinary(text or "")
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_columns_repeated_rows_and_null_ids_pass_through(spark, tmp_path):
    docs, labels, items = corpus()
    rows = [*docs.items(), (0, docs[0]), (None, "a text without an id"), (None, None)]
    folder = written(spark, tmp_path, rows, labels, items)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == [c.split()[0] for c in LONG_ROW.split(", ")], name
        kept.write.parquet(f"{folder}/{name}")
        kept = spark.read.parquet(f"{folder}/{name}")
    found = kept.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) and (r.score, r.uid, r.hits) == (7, "u", "h") for r in found)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).count() == len(found)


def test_empty_tables(spark, tmp_path):
    folder = written(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
