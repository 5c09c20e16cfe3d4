"""The near-dedup stage where rows share an id or have none."""

import corpus_pipeline


def test_shared_ids(spark):
    text = lambda k: " ".join(f"w{k}x{j * j % 97}" for j in range(60))
    rows = [(1, text(0)), (1, text(1)), (2, text(1)), (3, text(2)), (3, text(2)), (None, text(3)), (None, text(4)), (None, text(4))]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(str((r.doc_id, r.text)) for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(map(str, [(1, text(0)), (1, text(1)), (3, text(2)), (None, text(3)), (None, text(4))]))
