"""What must hold at any size: filters by range, hot keys, rows without an id, bounded samples, shards."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from meshwright.llm import common, langid, lines, mixing, ogg, passages, repeats, tokens, toxicity

WORDS = [f"w{k}" for k in range(500)]


def hashes():
    def run(batches):
        for b in batches:
            rows = b.column(1).to_pylist()
            h = [tokens.mix64(np.array(sorted(set(x)), np.uint64)) for x in rows]
            yield np.repeat(np.asarray(b.column(0)), [len(x) for x in h]), np.concatenate([np.zeros(0, np.uint64), *h])

    return run


@pytest.mark.parametrize("n", [500, 5000])
def test_small_filters_by_range_don_t_fill_up(spark, n):
    """Ranges of 2,048 bits: what is suspected stays near what repeats, however much there is."""
    rng = random.Random(n)
    docs = [(d, [10 * d + k for k in range(10)] + [-1 - rng.randrange(n // 5) for _ in range(rng.randrange(3))] + [-1]) for d in range(n)]
    df = spark.createDataFrame([(d, [x % (1 << 40) for x in h]) for d, h in docs], "d long, h array<long>").repartition(6)
    got = repeats.suspected(df, hashes(), 12 * n, part_bits=2048).collect()
    held = {}
    for d, h in docs:
        for x in set(h):
            held.setdefault(x, set()).add(d)
    code = {int(tokens.mix64(np.array([x % (1 << 40)], np.uint64)).view(np.int64)[0]): x for x in held}
    want = {(d, x) for x, own in held.items() if len(own) > 1 for d in own}
    found = [(r["key"], code[r["hash"]]) for r in got]
    assert len(found) == len(set(found)) and want <= set(found)
    assert len(found) - len(want) < 0.03 * 12 * n


def test_filters_of_nothing(spark):
    assert repeats.suspected(spark.createDataFrame([], "d long, h array<long>"), hashes(), 0).count() == 0


def test_each_pair_meets_once_in_bounded_parts(spark):
    few = spark.createDataFrame([(g, k) for g in range(3) for k in range(7 * g)], "group long, a long")
    many = common.scratch(spark.createDataFrame([(g, k) for g in range(4) for k in range(50 if g == 1 else 5)], "group long, b long"), "many")

    def run(batches):
        held = []
        for new, kind, part in common.routed_runs(batches):
            if new:
                held = []
            if kind == 0:
                held += part.column(0).to_pylist()
                continue
            for b in part.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array([b] * len(held), pa.int64()), pa.array([len(held)] * len(held), pa.int64())], names=["a", "b", "n"])

    from pyspark.sql import functions as F

    met, _ = common.routed(few, many, F.lit(1), 3, F.lit(1), 8)
    got = [tuple(r)[:2] for r in met.mapInArrow(run, "a long, b long, n long").collect()]
    want = [(a, b) for g in (1, 2) for a in range(7 * g) for b in range(50 if g == 1 else 5)]
    assert sorted(got) == sorted(want)


def test_many_rows_without_an_id(spark):
    """They are one document and need no more than others, however many they are."""
    rng = random.Random(4)
    line = "a long line that all of these rows hold, and more than forty characters"
    passage = " ".join(rng.choices(WORDS, k=40))
    own = [" ".join(rng.choices(WORDS, k=60)) for _ in range(1500)]
    rows = [(None, f"{t}\n{line}\n{passage}") for t in own] + [(k, f"{own[k]} x\n{line}\n{passage}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = lines.dedup_lines(df).collect()
    # the largest id keeps both long lines, rows without one lie below it
    assert sorted(r["n_dropped"] for r in got) == [0] + [2] * 1505
    assert {r["id"] for r in got if line in r["text"]} == {5}
    got = passages.remove_passages(df).collect()
    none = [r for r in got if r["id"] is None]
    # the smallest id keeps the passage; six of the texts stand in documents with an id as well
    assert len(none) == 1500 and {r["id"] for r in got if passage in r["text"]} == {0}
    assert all(r["n_removed"] >= 40 for r in none) and sum(r["n_removed"] >= 100 for r in none) == 6


@pytest.mark.parametrize("shard_chars", [300, 1 << 19])
def test_passages_go_by_their_automata_only(spark, shard_chars):
    class Blind(passages.Phrases):
        def locate(self, texts):
            return tuple(np.zeros(0, np.int64) for _ in range(3))

    rng = random.Random(8)
    shared = [rng.choices(WORDS, k=30) for _ in range(4)]
    df = spark.createDataFrame([(d, " ".join(rng.choices(WORDS, k=20) + shared[d % 4] + rng.choices(WORDS, k=20))) for d in range(40)], "doc_id long, text string")
    seen = {r["id"]: r["n_removed"] for r in passages.remove_passages(df, shard_chars=shard_chars).collect()}
    assert all(seen[d] >= 30 for d in range(4, 40)) and not any(seen[d] for d in range(4))
    assert not any(r["n_removed"] for r in passages.remove_passages(df, shard_chars=shard_chars, phrase_type=Blind).collect())


def test_phrases_are_located_where_they_stand():
    rng = random.Random(6)
    vocab = [f"v{k}" for k in range(9)]
    for window in (2, 3):
        found = sorted({" ".join(rng.choices(vocab, k=window)) for _ in range(25)})
        p = passages.Phrases(pa.array(found), np.arange(len(found)), window)
        texts = [" ".join(rng.choices([*vocab, "other"], k=rng.randrange(30))) for _ in range(40)]
        row, word, passage = p.locate(pa.array(texts))
        want = [(r, k, found.index(" ".join(t.split()[k : k + window]))) for r, t in enumerate(texts) for k in range(len(t.split()) - window + 1) if " ".join(t.split()[k : k + window]) in found]
        assert list(zip(row.tolist(), word.tolist(), passage.tolist(), strict=True)) == want


def test_toxicity_sample_keeps_both_labels(spark):
    assert toxicity.fitting([(1, 0, 100), (2, 1, 5), (3, 0, 5), (4, 1, 50)], 60) == [(3, 0), (2, 1)]
    assert toxicity.fitting([(1, 0, 1000), (2, 1, 1000)], 10) == [(1, 0), (2, 1)] and toxicity.fitting([], 10) == []
    rows = [(0, "word " * 5000)] + [(k, f"good words here {k}" if k % 2 else f"bad things there {k}") for k in range(1, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(200)], "doc_id long, toxic int")
    m = toxicity.train(docs, labels, sample_bytes=3000)
    got = {r["id"]: r["score"] for r in toxicity.score(docs, m).collect()}
    assert got[2] > 0.5 > got[1]


def test_features_are_the_plain_n_grams():
    text = "One two, three two three two"
    batch = tokens.WordBatch(pa.array([text, "", "two three"]), lower=True, apart=tokens.NOT_ALNUM)
    w = text.lower().replace(",", "").split()
    grams = {(1, x) for x in w} | {(2, a, b) for a, b in zip(w, w[1:], strict=False)} | {(3, a, b) for a, b in zip(w, w[2:], strict=False)}
    got = toxicity.features(batch)
    assert len(got[0]) == len(grams) and len(got[1]) == 0 and len(got[2]) == 3 and set(got[2]) <= set(got[0])


def test_ftrl_is_the_plain_loop():
    rng = random.Random(12)
    rows = [(np.array(sorted(rng.sample(range(30), rng.randrange(1, 8)))), rng.randrange(2)) for _ in range(120)]
    rows += [(np.array([0, 1, 2]), 1)] * 30
    alpha, beta, l1, l2 = 0.5, 1.0, 0.7, 0.1
    z, n, zb, nb = {}, {}, 0.0, 0.0
    p1 = sum(y for _, y in rows)
    bias = np.log(p1 / (len(rows) - p1))

    def w(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(3):
        for x, y in rows:
            own = {i: w(i) for i in x}
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-(bias + wb + sum(own.values())))) - y
            for i in x:
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * own[i]
                n[i] = before + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    m = toxicity.fit(rows, 3, alpha, beta, l1, l2)
    want = {i: w(i) for i in z if w(i)}
    assert m.slots.tolist() == sorted(want) and m.weights == pytest.approx([want[i] for i in sorted(want)])
    assert m.bias == pytest.approx(bias - zb / ((beta + nb**0.5) / alpha))


def test_em_counts_are_those_of_all_segmentations():
    vocab = ["a", "b", "ab", "ba", "aba"]
    words, smooth = {"abab": 3, "aba": 2, "bb": 1}, 0.05
    one = langid.fit({"x": words}, vocab, rounds=1, smooth=smooth)
    p = dict.fromkeys(vocab, 1 / len(vocab))

    def cuts(word):
        return [[]] if not word else [[v, *c] for v in vocab if word.startswith(v) for c in cuts(word[len(v) :])]

    want = dict.fromkeys(vocab, smooth)
    for word, times in words.items():
        share = [(c, np.prod([p[v] for v in c])) for c in cuts(word)]
        for c, q in share:
            for v in c:
                want[v] += times * q / sum(x for _, x in share)
    at = {int(h): k for k, h in enumerate(one.hashes)}
    got = {v: one.prob[at[langid.piece_hash(v)], 0] for v in vocab}
    assert got == pytest.approx({v: x / sum(want.values()) for v, x in want.items()})


def test_language_sample_takes_rows_of_one_id(spark):
    """All rows share an id, or have none: each is drawn by its text."""
    a, b = ["the cat sat on a mat", "where is the house"], ["der hund und die katze", "wo ist das haus"]
    for i in (None, 3):
        rows = [(i, f"{t} {k}", lang) for k in range(100) for lang, own in (("en", a), ("de", b)) for t in own]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        m = langid.train(docs, sample_rows=10)
        assert m.langs == ["de", "en"]


def test_media_hold_the_text(spark):
    import hashlib
    import zlib

    texts = ["", None, "x", "é" * 32, "long " * 30000, "x"]
    media = ogg.to_media(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    stored = {r["id"]: bytes(r["media"]) for r in media.collect()}
    rows = {r["doc_id"]: r for r in ogg.digest(media.withColumnRenamed("id", "doc_id")).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[k]), hashlib.sha256(stored[k]).hexdigest())
        x = np.frombuffer(full, np.uint8).astype(int)
        want = f";mean={x.sum() * 1000 // len(x)};power={(x * x).sum() * 1000 // len(x)};peak={x.max()};turns={sum((p >= 128) != (q >= 128) for p, q in zip(x, x[1:], strict=False))}"
        assert r["feature"].endswith(want)
    assert tuple(rows[2])[1:] == tuple(rows[5])[1:]
    bad = media.selectExpr("id", "n_bytes", "case when id = 2 then substring(media, 1, 70) when id <> 3 then media end as media")
    got = {r["doc_id"]: r for r in ogg.digest(bad.withColumnRenamed("id", "doc_id"), strict=False).collect()}
    assert got[2]["error"] and got[2]["payload_sha256"] is None and got[3]["error"] and got[4]["error"] is None and got[4]["feature"] == rows[4]["feature"]


def test_mix_of_equal_keys_is_exact(spark):
    """Half of the rows have no id and so one key; equal rows, sizes of zero, one row over the whole budget."""
    rng = random.Random(3)
    rows = [(None if k % 2 else k, "a" if k % 3 else None, rng.randrange(4), f"t{k % 50}") for k in range(600)] + [(9999, "big", 5000, "x"), (9998, "none", 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text string").repartition(4)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7)).collect()))
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)


def test_mix_stage_keeps_columns_of_its_names(spark):
    docs = spark.createDataFrame([(k, "some words here", "en", "a", 15, f"own {k}", k) for k in range(5)], "doc_id long, text string, lang string, source string, n_chars long, size string, doc_taken int")
    out = corpus_pipeline.mixture(spark, docs, "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "doc_size", "doc_taken", "size", "source_size", "target", "taken"]
    assert all(r["doc_size"] == f"own {r['doc_id']}" and r["size"] == 3 for r in out.collect())


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "app", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
    Context.master = "local[4]"
    assert common.shared_dir(Session()).endswith("/app")


def test_what_a_stage_needed_goes_when_its_result_is_stored(spark):
    made = []

    def make():
        made.append(common.scratch(spark.range(5).toDF("x"), "inner"))
        return made[0].filter("x > 1")

    out = common.stored(spark, make, "outer")
    assert out.count() == 3 and not os.path.exists(made[0].scratch_path.removeprefix("file://"))
    common.discard(out)


@pytest.mark.parametrize("at_once", [0, 1 << 20])
def test_components_either_way(spark, at_once):
    from meshwright.llm import components

    rng = random.Random(at_once)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5, None), (7, 7), (2000, 2001), (2001, 2000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if v is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "u long, v long"), at_once=at_once).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in list(root))
    assert components.components(spark.createDataFrame([], "u long, v long"), at_once=at_once).count() == 0


def test_short_items_remove_nothing(spark):
    from meshwright.llm import decontaminate

    docs = spark.createDataFrame([(1, "the end of it"), (2, "one two three four five six"), (3, "else")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the end"), (2, "two three four five six")], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.remove_contaminated(docs, bench).orderBy("doc_id").collect()] == [1, 3]
    assert sorted(map(tuple, decontaminate.overlaps(docs, bench).collect())) == [(1, 1, 2, 2), (2, 2, 5, 5)]
