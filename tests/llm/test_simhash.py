"""SimHash against brute force over all pairs of a small table."""

import re

import numpy as np
import xxhash

from meshwright.llm import simhash

ROWS = [
    (5, "The cat sat on the mat and looked at the moon all night long"),
    (3, "the CAT sat on the mat  and looked\tat the moon all night long"),
    (9, "a b"),
    (8, "A  B"),
    (1, ""),
    (7, None),
    (4, "single"),
    (5, "The cat sat on the mat and looked at the moon all night long"),
    (None, "a b"),
    (None, "nothing else reads like this one at all, it is alone"),
    (12, "word " * 30000),
]


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    s = [" ".join(w)] if len(w) < 3 else [" ".join(w[k : k + 3]) for k in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, most=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def expected(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    cls = brute_classes(fp)
    least = {}
    for (d, _), f in zip(rows, fp, strict=True):
        if d is not None:
            least[cls[f]] = min(least.get(cls[f], d), d)
    return sorted(((d, f"{f:016x}", least.get(cls[f])) for (d, _), f in zip(rows, fp, strict=True)), key=str)


def test_against_brute_force(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in ROWS], "doc_id long, text string, fp string, node int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == expected(ROWS)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def planted(n=60, seed=1):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 1 << 63, n, dtype=np.uint64):
        x = int(base)
        for _ in range(int(rng.integers(1, 12))):
            out.add(x)
            for b in rng.integers(0, 64, int(rng.integers(0, 4))):
                x ^= 1 << int(b)
    return sorted(out)


def check_links(spark, limit):
    fps = planted()
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(signed)], "node long, fp long")
    links = [(r.u, r.v) for r in simhash.fingerprint_links(df, 2, limit).collect()]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in links:
        root[find(u)] = find(v)
    want = brute_classes(fps)
    pairs = {(find(k), want[f]) for k, f in enumerate(fps)}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_links_span_every_class(spark):
    check_links(spark, 1 << 16)


def test_large_buckets_split_exactly(spark):
    check_links(spark, 1)


def test_index_prunes_but_loses_no_pair():
    rng = np.random.default_rng(7)
    words = np.unique(rng.integers(0, 1 << 14, 900, dtype=np.uint64))
    ranks = np.sort(simhash.gray_rank(words))
    words = simhash.gray_word(ranks)
    i, j = simhash.GrayIndex(words, np.zeros(len(words), np.int64)).links(np.arange(len(words)), 2)
    want = {(a, b) for a in range(len(words)) for b in range(a + 1, len(words)) if int(words[a] ^ words[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
