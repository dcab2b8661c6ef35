import numpy as np

from tracekit.llm import quality as Q

SF = "/root/testdata/sf0.01"


def auc(good, bad):
    good, bad = np.array(good), np.array(bad)
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_held_out_accuracy(lspark):
    scores = {r["doc_id"]: r for r in Q.op8_quality(lspark, SF).collect()}
    labels = lspark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [r for r in labels if scores[r["doc_id"]]["held_out"]]
    assert len(held) > 50
    by = {y: [scores[r["doc_id"]]["score"] for r in held if r["quality"] == y] for y in (0, 1)}
    assert auc(by[1], by[0]) > 0.97
    assert np.mean([scores[r["doc_id"]]["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in scores.values())


def test_held_out_labels_dont_count(lspark):
    docs = lspark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = lspark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(doc_id as string)), 4) = 2 then 1 - quality else quality end quality")
    a, b = (Q.train(docs, x, ~Q.held_out()) for x in (labels, flipped))
    x = Q.features(["Some text. Of words", "a a a a", "", None])
    assert np.allclose(a.score(x), b.score(x))
    assert np.allclose(a.score(x)[2], a.score(x)[3])


def test_the_risk_needs_no_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 1, (4000, 6)), rng.normal(-1, 1, (4000, 6))
    unlabelled = np.concatenate([good[1000:2400], bad[:600]])  # prior 0.7
    model = Q.fit(good[:1000], unlabelled, 0.7)
    assert (model.margin(good[2400:]) > 0).mean() > 0.95
    assert (model.margin(bad[600:]) < 0).mean() > 0.9


def test_odd_rows_are_scored(docs_of, lspark):
    rows = [(1, "Good text. With words"), (1, "Good text. With words"), (None, None), (2, ""), (3, "x" * 300_000), (4, "w " * 100_000), (5, "a\x00b")]
    labels = lspark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    scored = Q.score(docs, Q.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert Q.keep_good(docs, labels).columns == docs.columns


def test_without_labels_or_documents(docs_of, lspark):
    none = lspark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of([(1, "a b"), (2, "c")])
    assert Q.score(docs, Q.train(docs, none)).count() == 2
    assert Q.train(docs_of([]), none) is None
    assert Q.score(docs_of([]), None).collect() == []
