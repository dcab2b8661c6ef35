from collections import Counter, defaultdict

from tests.llm import brute
from tracekit.llm import mixing as M


def rows_of():
    docs = [(i, "w " * (1 + i % 11), f"s{i % 4}") for i in range(300)]
    docs += [(1000 + i, "tiny", "small") for i in range(6)] + [(2000, "x y " * 30_000, "huge")]
    docs += [(3000 + i, "n\u00e9 w", None) for i in range(20)] + [(None, "a b c", "s1")] * 30 + [(7, "copy of it", "s2")] * 50
    return docs + [(4000, None, "s0"), (4001, "", "s0"), (4002, " \t\n", "blank"), (4003, None, "blank")]


def test_targets_and_taken(docs_of):
    rows = rows_of()
    got = M.mix(docs_of(rows)).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((i, s) for i, _, s in rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(brute.space_words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute.water_fill({s: sizes[s] for s in order}, [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] += 1 if r["doc_id"] in (None, 7) else 0
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 + longest[s]  # rounding, and a word for each of equal rows at the cut
    assert max(len({r["taken"] // max(1, r["size"]) for r in got if r["source"] == s}) for s in sizes) <= 2


def test_reruns_agree(docs_of):
    rows = rows_of()
    one = sorted(map(tuple, M.mix(docs_of(rows)).collect()), key=repr)
    assert one == sorted(map(tuple, M.mix(docs_of(rows[::-1]).repartition(7)).collect()), key=repr)


def test_documents_are_repeated(docs_of):
    rows = rows_of()
    docs = docs_of(rows)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter((r["doc_id"], r["text"], r["source"]) for r in mixed.collect())
    copies = Counter(rows)
    taken = defaultdict(set)
    for r in M.mix(docs).collect():
        taken[r["doc_id"], r["source"]].add((r["taken"], r["size"]))
    for (i, text, source), n in copies.items():
        words, size = next(iter(taken[i, source]))
        if size and len(taken[i, source]) == 1:
            assert abs(times[i, text, source] / n - words / size) <= 0.5


def test_empty_table(docs_of):
    assert M.mix(docs_of([])).collect() == []
    assert M.mixed_documents(docs_of([])).collect() == []


def test_main_path_has_no_python(lspark):
    plan = M.op10_mixing(lspark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
