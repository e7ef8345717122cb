import random
import re
import time

import pytest

from lodestone.llm import secrets


def plain(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PARTS = ["password", "PASSWD", "Secret", "toKen", "api_key", "APIKEY", "apikey'", " : ", "=", '"', "abc123", "x" * 5, "AKIA", "A9" * 8, "0123456789abcdef" * 2, "é", "ſecret=abcdefg", "Key", " ", "\n", "deadbeef", "中", "tokentoken=abcdefgh"]


def test_against_plain_regexes():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    base = [[s for s in spans if secrets.RULES[s[1]].base] for spans in secrets.scan(texts)]
    assert base == [plain(t) for t in texts]
    assert sum(map(len, base)) > 300


def test_trigram_queries_are_implied_by_matches():
    hits = {"assign": 'API_KEY="abcdef"', "access": "AKIA" + "Z" * 20, "hex": "0" * 24, "pem": "-----BEGIN RSA PRIVATE KEY-----", "forge": "ghp_" + "a" * 40, "jwt": "eyJa.eyJb.c"}
    for rule in secrets.RULES:
        text = hits[rule.kind]
        assert re.search(rule.pattern, text, rule.flags)
        index = secrets.postings([text, "nothing"], secrets.trigrams(rule.query))
        assert 0 in secrets.lookup(rule.query, index, 2)
        assert (rule.query is True) == (rule.kind == "hex")
        assert (1 in secrets.lookup(rule.query, index, 2)) == (rule.kind == "hex")


@pytest.mark.parametrize("pattern", ["abc|abd", "a[bc]def+", "(foo|bar)?baz", "x{2,3}yzz", "ab(cd|ef)*gh", ".*key.*"])
def test_other_patterns_lose_no_match(pattern):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["abc", "abd", "def", "foo", "bar", "baz", "xx", "yzz", "cd", "ef", "gh", "key", "a", "b"]) for _ in range(5)) for _ in range(800)]
    query = secrets.trigram_query(pattern)
    candidates = set(secrets.lookup(query, secrets.postings(texts, secrets.trigrams(query)), len(texts)).tolist())
    assert {i for i, t in enumerate(texts) if re.search(pattern, t)} <= candidates


def test_rows(spark):
    rows = [(1, "token=abcdef"), (1, "token=abcdef"), (2, None), (3, ""), (None, "é AKIA" + "B" * 20)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, spans int")
    got = sorted(map(tuple, secrets.find_secrets(df).collect()), key=str)
    assert got == sorted([(1, "assign:0:12", "assign:0:12", 1, 0, 0)] * 2 + [(2, "", "", 0, 0, 0), (3, "", "", 0, 0, 0), (None, "access:2:26", "access:2:26", 0, 1, 0)], key=str)
    assert secrets.find_secrets(df.limit(0)).collect() == []


def test_letters_beyond_ascii_and_folding():
    texts = ["CLÉ=123", "clé=123", "\u017fecret=12", "SECRET=12", "\u212aey=5", "a\x00b=7", "x"]
    for pattern, flags in (("CLÉ=[0-9]+", 0), ("secret=[0-9]+", re.I), ("(?i)key=[0-9]+", 0), ("(?i:key)=[0-9]+", 0), ("clé=[0-9]+", re.I), ("a\x00b=", 0), ("SECRET=", 0)):
        rule = secrets.Rule("own", pattern, flags)
        want = [[(m.start(), 0, m.end()) for m in re.finditer(pattern, t, flags)] for t in texts]
        assert secrets.scan(texts, (rule,)) == want, pattern


def test_a_long_run_is_read_once():
    text = "eyJ" * 300_000 + ".eyJab"
    began = time.perf_counter()
    assert [x for x in secrets.scan([text])[0] if secrets.RULES[x[1]].kind == "jwt"] == []
    assert time.perf_counter() - began < 20
    kind = [r.kind for r in secrets.RULES].index("jwt")
    assert (4, kind, 19) in secrets.scan(["key=eyJab.eyJcd.sig "])[0]
