"""The near-dedup stage against brute force over the Jaccard similarity of 5-word shingles, and the fingerprints of op1_simhash."""

import os
import random
from itertools import combinations

import corpus_pipeline
import pytest
from meshwright.llm import nearcopies, simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.01"


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def kept(rows):
    """The least id of each class, by brute force over the pairs that share a shingle."""
    sets, holders = [shingles(t or "") for _, t in rows], {}
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(k)
        for j, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    held = {}
    for k, (_, t) in enumerate(rows):
        root[find(k)] = find(held.setdefault(simhash.fingerprint((t or "").encode()), k))
    for f in held:
        for bits in combinations(range(64), 2):
            for g in (f ^ 1 << bits[0], f ^ 1 << bits[1], f ^ 1 << bits[0] ^ 1 << bits[1]):
                g = (g & (1 << 64) - 1) - (1 << 64 if g & 1 << 63 else 0)
                if g in held:
                    root[find(held[f])] = find(held[g])
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(least.values()), len({frozenset(s) for s in sets})


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)
    return corpus_pipeline.near_dedup(spark, docs, "")


def test_edited_copies(spark):
    rnd, rows = random.Random(5), []
    for _ in range(8):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice((30, 120, 400)))]
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(1 + len(w) // 25)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, "Two words"), (201, "two  words"), (202, ""), (203, None), (204, "words two")]
    want, distinct = kept(rows)
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == want
    assert len(want) < distinct - 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want, distinct = kept(rows)
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == want
    assert len(want) < distinct


def grouped(rnd, size):
    """Many texts of one common part, a third of them in pairs of near copies: they share their blocks with all others."""
    common = [f"c{k}" for k in range(60)]
    out = []
    for k in range(size):
        own = [f"w{k}x{j}" for j in range(rnd.choice((14, 15, 16, 17)))]
        out.append(" ".join(common + own))
        if k % 3 == 0:
            out.append(" ".join([*common, *own[:-1], f"end{k}"]))
    return out


@pytest.mark.parametrize("ordered", [nearcopies.ORDERED, 300])
def test_large_blocks_lose_no_partner(spark, ordered):
    """The common part is more than 4/5 less two shingles, so blocks of 200 classes remain after all draws."""
    rows = list(enumerate(grouped(random.Random(3), 150)))
    want, _ = kept(rows)
    docs = spark.createDataFrame([(i, "", t) for i, t in rows], "own long, digest string, text string").withColumn("digest", F.md5("text"))
    got = nearcopies.near_copies(docs, ordered).groupBy("root").agg(F.min("own").alias("own")).collect()
    assert sorted(r.own for r in got) == want
    assert len(want) > 100


def test_only_candidates_keep_their_sets(spark):
    """Texts that share nothing with others are in no stored set, even where the order's sample is too small to tell."""
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{rnd.randrange(10**9)}" for _ in range(60))) for i in range(80)]
    rows.append((100, rows[0][1] + " more"))
    docs = spark.createDataFrame(rows, "own long, text string").withColumn("digest", F.md5("text"))
    _, sets, blocks = nearcopies._candidates(docs.select("own", "digest", "text"), 300)
    assert sets.count() == 2 and blocks.select("sig").distinct().count() == 2


def test_bitmaps_of_two_widths(spark):
    """Long near copies whose numbers of shingles lie on both sides of a bitmap's width, and pairs just too far apart."""
    rnd, rows = random.Random(21), []
    for size in (1026, 2050, 4100):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
        for edits, more in ((0, 0), (0, 9), (size // 60, 0), (size // 41, 12), (size // 25, 0)):
            w = base + [f"m{rnd.randrange(10**6)}" for _ in range(more)]
            for _ in range(edits):
                w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    want, distinct = kept(rows)
    assert sorted(r.doc_id for r in stage(spark, rows).collect()) == want
    assert 3 < len(want) < distinct


def test_common_passage_makes_few_blocks_and_no_set(spark, monkeypatch):
    """Long texts that share a passage are no near copies: few blocks stand for the passage, and the bitmaps tell, so no set is computed."""
    rnd = random.Random(13)
    passage = [f"p{k}" for k in range(900)]
    rows = [(i, " ".join([f"w{rnd.randrange(10**9)}" for _ in range(2200)] + passage)) for i in range(4)]
    docs = spark.createDataFrame(rows, "own long, text string").withColumn("digest", F.md5("text"))
    _, _, blocks = nearcopies._candidates(docs.select("own", "digest", "text"), 300)
    assert blocks.select("block").distinct().count() < 10  # the cut of a prefix makes some more; hundreds of shingles are shared
    made, write = [], nearcopies.scratch

    def recorded(df, name):
        out = write(df, name)
        if name == "sets" or (name in ("near", "found") and out.count()):
            made.append((name, out.count()))
        return out

    monkeypatch.setattr(nearcopies, "scratch", recorded)
    got = nearcopies.near_copies(docs.select("own", "digest", "text"), 300).collect()
    assert len({r.root for r in got}) == 4 and not [x for x in made if x[0] != "found"]
