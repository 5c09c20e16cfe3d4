"""The methods themselves: against brute force, invariants, held-out accuracy."""

import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshwright.llm import decontaminate as dc
from meshwright.llm import langid, mixing, passages, repeats, secrets_scan, tokens, toxicity

SF = "/root/testdata/sf0.01"
data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_words_are_what_the_pattern_says():
    texts = ["", None, " a\tbc \x0b\x0c d\x1c e", "x" * 5000, "é ü", "\x00 z", "a", "b"]
    b = tokens.WordBatch(pa.array(texts))
    for k, t in enumerate(texts):
        want = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert [b.word(w).decode() for w in range(b.first[k], b.first[k + 1])] == want
    same = tokens.WordBatch(pa.array(["q a", "a"]))
    assert same.hash[1] == same.hash[2] != same.hash[0]
    assert len(tokens.WordBatch(pa.array([], pa.string()))) == 0
    h = np.arange(50, dtype=np.uint64)
    assert tokens.rolling(np.r_[h, h], 7)[3] == tokens.rolling(np.r_[h, h], 7)[53]


def test_repeat_filter_misses_no_repeat(spark):
    rng = random.Random(3)
    docs = [[rng.randrange(4000) for _ in range(30)] for _ in range(300)]
    df = spark.createDataFrame([(d,) for d in docs], "h array<long>").repartition(5)

    def distinct(batches):
        for b in batches:
            yield np.concatenate([np.zeros(0, np.uint64), *(tokens.mix64(np.array(sorted(set(x)), np.uint64)) for x in b.column(0).to_pylist())])

    twice = repeats.RepeatFilter(repeats.repeat_filter(df, distinct, repeats.filter_bits(4000)))
    n = {k: sum(k in d for d in docs) for k in range(6000)}
    hit = dict(zip(n, twice.test(tokens.mix64(np.array(list(n), np.uint64))), strict=True))
    assert all(hit[k] for k in n if n[k] > 1) and sum(hit[k] for k in n if n[k] < 2) < 60
    assert repeats.filter_bits(10**12) == repeats.MAX_BITS


def test_masks_are_lossless():
    for pair in itertools.combinations(range(dc.WINDOW), dc.MISSES):
        found = False
        for m in dc.MASKS:
            ones = [k for k, c in enumerate(m) if c == "1"]
            found |= any(all(o + k not in pair for k in ones) for o in range(dc.WINDOW - len(m) + 1))
        assert found, pair


def test_overlaps_are_brute_force_s(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(30)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([3, 9, 12, 13, 14, 30])))) for i in range(12)]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=rng.randrange(60))
        own = rng.choice(items)[1].split()
        own = [x if rng.random() > 0.12 else "sub" for x in own]
        at = rng.randrange(len(w) + 1)
        docs.append((d, ", ".join(w[:at] + [x.upper() for x in own] + w[at:])))
    want = set()
    for (d, t), (i, x) in itertools.product(docs, items):
        a, b = re.findall("[a-z0-9]+", t.lower()), x.split()
        size, need = min(len(b), 13), len(b) if len(b) < 13 else 11
        cover = set()
        for off in range(-len(b), len(a)):
            for s in range(len(b) - size + 1):
                if 0 <= off + s and off + s + size <= len(a) and sum(a[off + k] == b[k] for k in range(s, s + size)) >= need:
                    cover |= set(range(s, s + size))
        if cover:
            want.add((d, i, len(b), len(cover)))
    one = [spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")]
    assert {tuple(r) for r in dc.overlaps(*one).collect()} == want
    assert {tuple(r) for r in dc.overlaps(*one, block_words=40).collect()} == want  # the benchmark in blocks


@pytest.mark.parametrize("shard_chars", [200, 1 << 21])
def test_passages_are_brute_force_s(spark, shard_chars):
    rng = random.Random(11)
    vocab = [f"v{k}" for k in range(200)]
    shared = [rng.choices(vocab, k=n) for n in (13, 14, 40, 700)]
    docs = []
    for d in range(50):
        w = []
        for _ in range(rng.randrange(5)):
            s = rng.choice(shared)
            lo = rng.randrange(max(1, len(s) - 12))
            w += rng.choices(vocab, k=rng.randrange(20)) + (s if rng.random() < 0.5 else s[lo : lo + rng.randrange(10, 80)])
        docs.append((d * 7 % 50, " ".join(w)))
    docs += [(100, docs[3][1]), (101, docs[3][1])]
    first = {}
    for d, t in docs:
        w = t.split()
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, d), d)
    want = set()
    for d, t in docs:
        w = t.split()
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                gone |= set(range(k, k + 13))
        want.add((d, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert {tuple(r) for r in passages.remove_passages(df, shard_chars=shard_chars).collect()} == want


def test_forward_sums_all_segmentations():
    vocab = ["a", "b", "ab", "ba", "aba", "▁", "▁a", "▁ab"]
    m = langid.fit({"x": {"▁ab": 3, "▁aba": 2}, "y": {"▁ba": 4}}, vocab)
    at = {int(h): k for k, h in enumerate(m.hashes)}

    def total(word, lang):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            k = at.get(langid.piece_hash(word[:n]))
            p = m.prob[k, lang] if k is not None else 0.0
            out += max(p, m.unknown if n == 1 else 0.0) * total(word[n:], lang)
        return out

    words = ["▁ab", "▁abab", "▁", "▁qb", "▁ba" * 3]
    got = m.log_probability(words)
    for w, row in zip(words, got, strict=True):
        assert row == pytest.approx([np.log(total(w, k)) for k in range(2)])
    assert np.allclose(m.prob.sum(axis=0), 1)
    s = langid.Scorer(m, keep=1)
    b = langid._batch(pa.array(["ab aba", "", "AB ab"]))
    one, two = s(b), s(b)
    assert np.allclose(one, two) and np.allclose(one[2], 2 * got[0], rtol=1e-5) and not one[1].any()


@data
def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs, langid.train(docs, sample_rows=60))
    held = found.join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").filter(langid.held_out(F.col("id")))
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97
    odd = spark.createDataFrame([(1, "1234 !?"), (2, None), (3, "Ω")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.predict(odd, langid.train(docs, sample_rows=5)).collect()][:2] == ["und", "und"]


@data
def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    assert 0 < len(m.slots) < 20000  # sparse
    own = docs.join(labels.filter(toxicity.held_out(F.col("doc_id"))).select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score(own, m).join(labels.select(F.col("doc_id").alias("id"), "toxic"), "id").select("score", "toxic").collect()
    pos, neg = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    auc = np.mean([(p > np.array(neg)).mean() + (p == np.array(neg)).mean() / 2 for p in pos])
    assert len(pos) > 50 and auc > 0.95 and np.mean(np.array(neg) >= 0.5) < 0.02
    assert toxicity.fit([]).bias < 0 and toxicity.fit([(np.array([1]), 0)]).bias < 0


def test_mix_is_exact(spark):
    rng = random.Random(2)
    docs = [(k, f"s{k % 4}" if k % 9 else None, rng.randrange(200)) for k in range(3000)] + [(5000, "tiny", 3)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    rows = mixing.mix(df).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))  # reruns agree
    sums, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    for s, (t, n) in target.items():
        assert sums[s] == int(t) and t <= 2 * n
    assert sum(t for t, _ in target.values()) == pytest.approx(1.5 * sum(d[2] for d in docs))
    # the targets are what resharing step by step gives
    names = sorted((s for s in target if s is not None)) + [None]
    w, share, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(d[2] for d in docs), {}
    while True:
        free = [s for s in names if s not in capped]
        level = (share - sum(capped.values())) / sum(w[s] for s in free)
        over = [s for s in free if w[s] * level > 2 * target[s][1]]
        if not over:
            break
        capped |= {s: 2.0 * target[s][1] for s in over}
    for s in names:
        assert target[s][0] == pytest.approx(capped.get(s, w[s] * level))


def is_random(w):
    upper, lower, digit = (re.search(p, w) for p in ("[A-Z]", "[a-z]", "[0-9]"))
    mark = re.search("[^A-Za-z0-9]", w)
    if not (upper or lower or mark):
        return False
    if not mark and not (upper and lower) and not re.search("[g-zG-Z]", w):
        least = 3.05
    elif not (digit or mark):
        least = 4.2
    else:
        least = 3.95 if mark or (upper and lower) else 3.75
    return -sum(w.count(x) / len(w) * np.log2(w.count(x) / len(w)) for x in set(w)) >= least


def test_secrets_in_very_long_texts(spark):
    """Texts that would overflow the stack of a matcher that recurses."""
    rng = random.Random(1)
    hexes, base64 = ("".join(rng.choices(a, k=1 << 20)) for a in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    texts = ["ab/" * 350000, "a-b_" * 262144, "=" * (1 << 20), "a-" * 500000 + "a", "token=" + "a." * 500000, "AKIA" + "A1" * 500000, hexes, base64, "x deadbeefdeadbeefdeadbeef" * 30000]
    rows = sorted(secrets_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect())
    span = lambda r, name: [(x["start"], x["end"]) for x in r[name]]
    assert [span(r, "entropy") for r in rows[:4]] == [[]] * 4
    assert span(rows[4], "assign") == [(0, 1000006)] and span(rows[5], "access") == [(0, 1000004)]
    assert span(rows[6], "hex") == [(0, 1 << 20)] and span(rows[6], "entropy")[0][1] > 1000000
    assert span(rows[7], "entropy")[0][0] < 100 and len(rows[7]["entropy"]) == 1
    assert span(rows[8], "hex") == [(26 * k + 2, 26 * k + 26) for k in range(30000)]


def test_secrets_are_brute_force_s(spark):
    rng = random.Random(9)
    bits = ["password", "Token", "=", ": ", '"', "api_key", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "é", " ", "x", "abc", "aPiKey='", "q7Zp2LxV9bN4kR8sT1wY6uHm", "thisisjustalongwordthatgoeson", "0123456789", "\n", "31415926535897932384626433", "9F86D081884C7D659A2FEAA0C55AD015", "mfrggzdfmztwq2lk7n3x5p", "KRSXG5CTMVRXEZLU2Q4W6A", "getElementsByClassName", "a/b-c_", "--"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(200)]
    kw = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = secrets_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == 200
    for r in rows:
        t = texts[r["id"]]
        span = lambda name: [(x["start"], x["end"]) for x in r[name]]  # noqa: B023, E731
        assert span("assign") == [m.span() for m in kw.finditer(t) if len(m[2]) >= 6]
        assert span("access") == [m.span() for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        assert span("hex") == [m.span() for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want = []
        for m in re.finditer(secrets_scan.CANDIDATE, t):
            c = m[0]
            if re.search(secrets_scan.ALLOWED, c) or re.fullmatch("[A-Za-z]+([-_/][A-Za-z]+)+", c):
                continue
            n = secrets_scan.WINDOW
            good = [o for o in range(len(c) - n + 1) if is_random(c[o : o + n])]
            if good:
                want.append((m.start() + good[0], m.start() + good[-1] + n))
        assert span("entropy") == want
    assert sum(len(r["entropy"]) for r in rows) > 10
