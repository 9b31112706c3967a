from __future__ import annotations

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import randomness as rn
from quillspark.llm import registry
from quillspark.llm import secrets as s

# The patterns of the contract, unabridged.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def joined(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def test_query_against_brute_force(spark):
    data = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op7_secrets"](spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]])
        kinds = [k for _, k, _ in want]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(kinds.count(k) for k in range(3))
        assert r["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(r["spans"].split(","))


@pytest.mark.parametrize("text", ["PASSWORD: abcdefgh token='x1234567' passwd = short", "secret=a.b", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "x" + "0a" * 12 + "Z" + "f" * 23, "é api_key:abcdef ſecret=abcdefgh", "password=token=abcdef", "token token: 'abcdef' secret:: abcdefg", 'api"key":"abcdefg"'])
def test_base_patterns(text):
    assert s.base_spans(text) == base(text)


def test_random_strings_are_found_and_words_left_alone(spark):
    r = random.Random(3)
    keys = ["".join(r.choice(string.ascii_letters + string.digits) for _ in range(40)) for _ in range(30)]
    words = ["".join(r.choice(["tion", "er", "on", "the", "and", "re", "ing"]) for _ in range(9)) for _ in range(300)]
    rows = [(i, f"some words here {k} and more") for i, k in enumerate(keys)] + [(100 + i, f"and {w} so on") for i, w in enumerate(words)]
    rows.append((999, " ".join(WORDS * 20)))
    rows += [(900, "-" * 60), (901, "a" * 50), (902, "=" * 30 + " " + "ab" * 20), (903, "0123456789" * 4)]
    got = {x["doc_id"]: x for x in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i]["n_random"] == 1 for i in range(30)) >= 27
    assert sum(got[i]["n_random"] for i in range(100, 400)) == 0 and all(got[i]["n_random"] == 0 for i in range(900, 904))
    assert got[0]["spans"] == f"random:16:{16 + 40}" or got[0]["n_random"] == 0


def test_values_behind_names_and_beside_base_spans(spark):
    r = random.Random(4)
    key = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    names = ["client_key=", "sig=", "AWS_ACCESS=", "https://example.org/?auth=", "MY_SERVICE_NAME="]
    keys = [(names[i % len(names)], key(40) + "Aa0" + "=" * (i % 3)) for i in range(30)]
    rows = [(i, f"{n}{k}\n") for i, (n, k) in enumerate(keys)]
    # A key that ends in a hexadecimal base span: what is left of it is tested.
    tails = [key(40) + "Z" + "0a1b" * 8 for _ in range(10)]
    rows += [(100 + i, f"x {t} y") for i, t in enumerate(tails)]
    rows += [(200, "configurationsettings=theinternationalization"), (201, "=" * 40), (202, "a=b=c" * 10), (203, " ".join(WORDS * 20))]
    got = {x["doc_id"]: x["spans"] for x in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == f"random:{len(n)}:{len(n) + len(k)}" for i, (n, k) in enumerate(keys)) >= 27
    assert sum(got[100 + i].startswith(f"random:2:{2 + 41},hex:") for i in range(10)) >= 8
    assert not any("random" in got[i] for i in (200, 201, 202))


def test_threshold_is_the_step_up_rule():
    p = [10 ** (-b * s.BIN) for b in range(0, 200, 7)]
    counts = {b: 1 for b in range(0, 200, 7)}
    cut = s.threshold(counts, len(p), 1.0, 0.01)
    ranked = sorted(p)
    want = max((k + 1 for k, x in enumerate(ranked) if x * len(p) / (k + 1) <= 0.01), default=0)
    assert sum(b >= cut for b in counts) == want
    assert s.threshold({}, 0, 0.0, 0.01) == s.BINS + 1
    # Candidates that no encoding fits, and weights that are twice as large on average, both ask for smaller p.
    assert s.threshold(counts, 50 * len(p), 1.0, 0.01) > cut and s.threshold(counts, len(p), 50.0, 0.01) > cut


WORDS = "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but our one other do no information time they site he up may what which their news out use any there see only so his when contact here business who web also now help get view online first been would how were services some these click its like service than find price date back top people had list name just over state year day into email two health world next used go work last most products music buy data make them should product system post her city add policy number such please available copyright support message after best software then good video well where info rights public books high school through each links she review years order very privacy book items company read group need many user said does set under general research university january mail full map reviews program life know games way days management part could great united hotel real item international center must store travel comments made development report off member details line terms before hotels did send right type because local those using results office education national car design take posted internet address community within states area want phone shipping reserved subject between forum family long based code show even black check special prices website index being women much sign file link open today technology south case project same pages version section own found sports house related security both county american photo game members power while care network down computer systems three total place end following download him without per access think north resources current posts big media law control water history pictures size art personal since including guide shop directory board location change white text small rating rate government children during return students shopping account times sites level digital profile previous form events love old main call hours image department title description".split()


def ordinary(r, n):
    """Words up to n characters, joined as identifiers, paths and compounds are."""
    glue = r.choice(["", "_", "-", "/", "camel"])
    out = r.choice(WORDS)
    while len(out) < n:
        word = r.choice(WORDS)
        out += word.capitalize() if glue == "camel" else ("" if glue == "camel" else glue) + word
    return out[:n]


@pytest.fixture(scope="module")
def nulls():
    return rn.nulls_of(rn.trigrams([w.encode() for w in WORDS * 50]))


def test_p_values_of_ordinary_strings_are_not_too_small(nulls):
    r = random.Random(5)
    for n in (20, 28, 40, 64, 200):
        p = sorted(rn.battery(ordinary(r, n), nulls)[1] for _ in range(3000))
        assert p[3] >= 0.001 and p[30] >= 0.01


SYMBOLS = {e.name: e.symbols for e in rn.ENCODINGS}


def drawn(r, name, n):
    return "".join(r.choice(SYMBOLS[name]) for _ in range(n))


@pytest.mark.parametrize("name", rn.NAMES)
def test_p_values_of_each_encoding(nulls, name):
    """Other ordinary strings of the encoding, from another seed, have uniform p-values or larger; random ones have small ones."""
    which, r = rn.NAMES.index(name), np.random.default_rng(99)
    stream = rn.ordinary(which, rn.Letters(rn.trigrams([w.encode() for w in WORDS * 50])), r, 1 << 18)
    for n in (20, 40, 64):
        null = nulls[which, n]
        x = stream[r.integers(0, len(stream) - n, 4000)[:, None] + np.arange(n)]
        p = np.array([null.p(v) for v in rn.statistics(x, which) @ null.weights])
        for level in (0.3, 0.05, 0.01):
            assert (p <= level).mean() <= 1.6 * level
    q = random.Random(10)
    for n in (40, 64):
        found = [rn.battery(drawn(q, name, n), nulls) for _ in range(400)]
        assert sum(f is not None and f[1] <= 0.005 for f in found) >= 0.9 * len(found)


@pytest.mark.parametrize(("name", "n", "least"), [("hex", 20, 0.7), ("hex", 22, 0.7), ("HEX", 20, 0.65), ("HEX", 40, 0.9), ("base32", 40, 0.9), ("base32", 64, 0.97), ("alnum", 40, 0.9), ("alnum", 64, 0.97), ("base64", 40, 0.9), ("base64url", 64, 0.97), ("base36", 32, 0.9), ("BASE36", 40, 0.9)])
def test_keys_in_ordinary_texts_are_found(spark, name, n, least):
    r = random.Random(n)
    keys = [drawn(r, name, n) for _ in range(120)]
    rows = [(i, " ".join(r.choices(WORDS, k=40)) + f" {k} " + " ".join(r.choices(WORDS, k=20))) for i, k in enumerate(keys)]
    rows += [(1000 + i, "x " + ordinary(r, r.randint(20, 60)) + " y") for i in range(120)]
    got = {x["doc_id"]: x for x in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A base span may hold the key; what counts is that it is reported whole.
    hit = sum(f":{rows[i][1].index(k)}:{rows[i][1].index(k) + n}" in got[i]["spans"] for i, k in enumerate(keys))
    assert hit >= least * len(keys)
    assert sum(got[1000 + i]["n_random"] for i in range(120)) <= 0.03 * hit + 1


def test_false_discoveries_stay_below_the_rate(nulls):
    r = random.Random(6)
    wrong = []
    for _ in range(60):
        rows = [(ordinary(r, r.choice([20, 24, 32, 48, 64, 90])), False) for _ in range(300)] + [(drawn(r, r.choice(["alnum", "HEX", "base32"]), r.choice([24, 32, 64])), True) for _ in range(5)]
        found = [((rn.battery(t, nulls) or (0, 1.0))[1], s.weight(len(t)), y) for t, y in rows]
        mean = sum(w for _, w, _ in found) / len(found)
        bins = [min(max(int((-math.log10(p) + math.log10(w)) / s.BIN), 0), s.BINS) for p, w, _ in found]
        cut = s.threshold(Counter(bins), len(found), mean, 0.1)
        hit = [y for b, (_, _, y) in zip(bins, found, strict=True) if b >= cut]
        wrong.append(hit.count(False) / max(len(hit), 1))
    assert sum(wrong) / len(wrong) <= 0.1


def test_statistics_against_plain_formulas():
    r = random.Random(7)
    for text in [ordinary(r, 30), drawn(r, "alnum", 40), "ab" * 12, "AB23" * 6, "a" * 25, drawn(r, "base32", 33), drawn(r, "base64", 50), "a1b2" * 6]:
        which = rn.encoding(text)
        e, n = rn.ENCODINGS[which], len(text)
        x = np.frombuffer(text.encode(), np.uint8)[None, :]
        seen = Counter(text)
        chi = sum((seen[c] - n / e.size) ** 2 / (n / e.size) for c in e.symbols)
        assert rn.chi_squared(rn.VALUES[which][x], e.size)[0] == pytest.approx(chi)
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "-" for c in text]
        changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))

        def corr(v):
            m = sum(v) / n
            var = sum((a - m) ** 2 for a in v)
            return sum((a - m) * (b - m) for a, b in zip(v, v[1:], strict=False)) / var if var else None

        values, vowels = corr([e.symbols.index(c) for c in text]), corr([c.lower() in "aeiouy" for c in text])
        want = [(chi / (e.size - 1)) ** (1 / 3), changes / (n - 1), 1.0 if values is None else values, vowels or 0.0]
        assert rn.statistics(x, which)[0] == pytest.approx(want)


def test_inferred_encodings():
    want = {"0a" * 12: "hex", "0A" * 12: "HEX", "XYZ234": "base32", "abc019z": "base36", "ABC019Z": "BASE36", "aB3": "alnum", "a/b": "base64", "a/b==": "base64", "a-b_c": "base64url", "XYZD==": "base32", "1234567890": None, "-" * 9: None, "a-b/c": None, "12/34": None, "": None}
    assert {k: rn.encoding(k) if rn.encoding(k) is None else rn.NAMES[rn.encoding(k)] for k in want} == want


def test_trigrams_of_a_table(spark):
    texts = ["The cat, the-dog a", None, "", "Ünder word2 x" + "y" * 30 + " to\nof", "in", "token=abc AB", "b"]
    words = ["the", "cat", "a", "to", "of", "in", "ab", "b"]
    got = s.trigrams(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    assert np.array_equal(got, rn.trigrams([w.encode() for w in words]))


def test_simulation_in_tasks_is_the_plain_one(spark, monkeypatch):
    counts = rn.trigrams([w.encode() for w in WORDS * 5])
    got, want = s.simulated(spark, counts), rn.nulls_of(counts)
    assert got.keys() == want.keys() and all(np.allclose(got[k].weights, want[k].weights) and got[k].scale == pytest.approx(want[k].scale) for k in want)


def test_random_spans_against_the_exact_rule(spark):
    r = random.Random(8)
    texts = {}
    for i in range(200):
        parts = [ordinary(r, r.randint(15, 90)) for _ in range(r.randint(0, 4))]
        if i % 5 == 0:
            parts.append(drawn(r, "alnum", r.randint(20, 60)))
        parts += ["/" * 30] * (i % 3 == 0) + r.choices(WORDS, k=30)
        r.shuffle(parts)
        texts[i] = " ".join(parts)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    own = s.simulated(spark, s.trigrams(d))
    found = [(i, m.start(), m.end()) for i, t in texts.items() for m in re.finditer(r"\S{20,}", t)]
    assert all(re.fullmatch(r"[A-Za-z0-9+/_-]+", texts[i][a:b]) for i, a, b in found)
    w = [min(b - a, 64) / 32 for _, a, b in found]
    p = [(rn.battery(texts[i][a:b], own) or ("", 1.0))[1] * sum(w) / len(w) / x for (i, a, b), x in zip(found, w, strict=True)]
    order = sorted(range(len(p)), key=p.__getitem__)
    k = max((k + 1 for k, j in enumerate(order) if p[j] * len(p) / (k + 1) <= s.ALPHA), default=0)
    want = {found[j] for j in order[:k]}
    got = set()
    for x in s.find_secrets(d).collect():
        got |= {(x["doc_id"], *map(int, y.split(":")[1:])) for y in x["spans"].split(",") if y.startswith("random")}
    # Bins of a twentieth of a decade may leave out what lies at the very edge.
    assert got <= want and len(want - got) <= 2 and len(want) >= 20


def test_many_base_spans_in_one_text():
    text = " ".join(f"token=abcdef{i}" + "Zz9" * 9 for i in range(30_000))
    base = s.base_spans(text)
    began = time.perf_counter()
    assert len(base) == 30_000 and s.candidates(text, base) == []
    assert time.perf_counter() - began < 5


def test_edges(edge, nothing):
    got = s.find_secrets(edge).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(got) == edge.count() and all(r["base_sha256"] == none and r["spans"] == "" for r in got if r["doc_id"] in (1, 2, 3))
    assert s.find_secrets(nothing).count() == 0
