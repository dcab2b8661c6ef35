from collections import Counter

import corpus_pipeline as P
from tests.llm import brute
from tracekit.llm import decontaminate, mixing, queries

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(lspark, tmp_path):
    docs = lspark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(lspark, docs, SF)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = lspark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.collect())
    start, good, unique, clean, mixed, shards = seen

    labels = {r["doc_id"]: r["quality"] for r in lspark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    assert sum(labels[r["doc_id"]] != (r["doc_id"] in kept) for r in start if r["doc_id"] in labels) <= 2

    sets = {r["doc_id"]: brute.shingles(r["text"], 5) for r in good}
    want = brute.groups(sets, brute.near_links(sets, 80))
    assert sorted(r["doc_id"] for r in unique) == sorted({want[i] for i in sets})

    items = [brute.plain_words(r["text"]) for r in lspark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"] for r in unique} - {r["doc_id"] for r in clean}
    for r in unique:
        words = brute.plain_words(r["text"])
        runs = {tuple(words[i:i + 13]) for i in range(len(words) - 12)}
        leak = any(tuple(item[i:i + 13]) in runs for item in items for i in range(len(item) - 12))
        assert leak <= (r["doc_id"] in gone)
        if r["doc_id"] in gone:
            best = max(brute.best_overlap(words, item, decontaminate.MAX_SUBSTITUTED)[0] for item in items)
            assert best >= decontaminate.MIN_WORDS

    sizes = Counter()
    for r in clean:
        sizes[r["source"]] += len(brute.space_words(r["text"]))
    order = sorted(sizes)
    target = brute.water_fill({s: sizes[s] for s in order}, [mixing.WEIGHTS[k % 3] for k in range(len(order))], 3)
    got, longest = Counter(), Counter()
    for r in mixed:
        got[r["source"]] += len(brute.space_words(r["text"]))
    for r in clean:
        longest[r["source"]] = max(longest[r["source"]], len(brute.space_words(r["text"])))
    assert all(abs(got[s] - target[s]) <= longest[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3

    assert Counter(r["doc_id"] for r in shards) == Counter(r["doc_id"] for r in mixed)
    assert {s for r in shards for s in [r["shard"]]} <= set(range(24))


def test_run_equals_its_stages(lspark):
    assert P.run(lspark, SF).count() > 50
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
