"""The pipeline's stages, each against a plain version on its own input."""

import re

import corpus_pipeline
from meshwright.llm import simhash

LONG = "A line that many documents share, and it is longer than forty characters."
ITEM = "which of these thirteen words here would ever be asked in a real test"


def table(spark):
    rows, n = [], 0

    def add(text, lang="en", source="a", times=1):
        nonlocal n
        for _ in range(times):
            rows.append((n, text, lang, source, len(text or "")))
            n += 1

    for k in range(12):
        body = " ".join(f"plain word{(k * 37 + j * j) % 101}x of text" for j in range(40))
        add(body + ("\n" + LONG if k < 6 else ""), source="ab"[k % 2])
    add("the same text here " * 12, times=3)
    add("12345 67890 !!", source="b")
    add("", source="b")
    add(None)
    add("some words before " + ITEM + " and some words behind it")
    rows.append((None, "a text without an id stays in " * 5, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = table(spark)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, f"file://{tmp_path}")
        out.write.parquet(f"file://{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"file://{tmp_path}/{len(seen)}")
        seen[name] = (docs.collect(), out.collect())
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = out
    before, after = seen["language ID"]
    letters = [r for r in before if r.text and re.search("[^\\W\\d_]", r.text)]
    assert sorted(map(str, after)) == sorted(map(str, letters))
    before, after = seen["line dedup"]
    holders = [r.doc_id for r in before if LONG in r.text]
    assert [r.doc_id for r in after if LONG in r.text] == [max(holders)] and len(after) == len(before)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near dedup"]
    fp = {r.text: simhash.fingerprint(r.text.encode()) for r in before}
    root = {f: f for f in fp.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for r in before:
        c = find(fp[r.text])
        least[c] = min(least.get(c, float("inf")), float("inf") if r.doc_id is None else r.doc_id)
    assert sorted(str(r.doc_id) for r in after) == sorted(str(None if v == float("inf") else v) for v in least.values())
    before, after = seen["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {r.doc_id for r in before if ITEM in r.text}
    before, after = seen["mixing"]
    assert all(0 < r.taken <= 2 * r.size == 2 * len(r.text.split()) for r in after)
    for s in {r.source for r in after}:
        assert sum(r.taken for r in after if r.source == s) == int(next(r.target for r in after if r.source == s))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    table(spark).limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
