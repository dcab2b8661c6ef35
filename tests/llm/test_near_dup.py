import random
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tracekit.llm import near_dup as N


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    out = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    base = [word() for _ in range(70)]
    for _ in range(90):  # one large group, and texts that share much with it but not enough
        copy = list(base)
        for _ in range(rng.choice((1, 1, 2, 9))):
            copy[rng.randrange(70)] = word()
        out.append(" ".join(copy))
    passage = " ".join(word() for _ in range(40))
    out += [passage + " " + " ".join(word() for _ in range(20)) for _ in range(40)]
    out += [out[0].upper(), out[0], out[0].replace(" ", "\n\t"), out[70], "one", "One", "one two", None, "", " \n", None]
    out.append(" ".join(word() for _ in range(30_000)))
    return out + [out[-1] + " end"]


@pytest.mark.parametrize("size, percent, how", [(3, 85, {}), (5, 80, {"leaf": 12, "depth": 3})])
def test_equals_brute_force(docs_of, size, percent, how):
    rows = [(100 + 7 * i % 331, t) for i, t in enumerate(texts())]
    assert len({i for i, _ in rows}) == len(rows)
    got = {r["doc_id"]: r for r in N.near_duplicates(docs_of(rows), size, percent, **how).collect()}
    sets = {i: brute.shingles(t, size) for i, t in rows}
    want = brute.groups(sets, brute.near_links(sets, percent))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def test_repeated_and_null_ids_and_what_stays(docs_of):
    t = texts()
    rows = [(5, t[0])] * 300 + [(5, t[1]), (4, t[1]), (None, t[2]), (None, t[2]), (None, t[3]), (9, t[3]), (None, ""), (11, ""), (11, None)]
    docs = docs_of(rows)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs).collect())
    assert got == Counter({(5, 5, True): 300, (5, 4, False): 1, (4, 4, True): 1, (None, None, False): 3, (None, 9, False): 1, (9, 9, True): 1, (11, 11, True): 2})
    left = N.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(5, t[0]), (4, t[1]), (None, t[2]), (9, t[3]), (None, ""), (11, ""), (11, None)])


def test_empty_table(docs_of):
    assert N.near_duplicates(docs_of([])).collect() == []
    assert N.drop_near_duplicates(docs_of([])).collect() == []


def test_links_of_counts_exactly(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64) << np.uint64(57)) for _ in range(12)] + [np.empty(0, np.uint64)]
    monkeypatch.setattr(N, "RANGE_SHINGLES", 37)
    a, b = N.links_of(sets, 60)
    plain = {i: set(s.tolist()) for i, s in enumerate(sets)}
    assert [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x != 12 and y != 12] == brute.near_links(plain, 60)


def test_missed_follows_a_simulation():
    rng = np.random.default_rng(4)
    runs, lost = 20_000, 0
    for same in rng.binomial(N.SKETCH, 0.5, runs) / N.SKETCH:
        alive = rng.binomial(2, same, 2)  # two picks in each of two trees, two levels
        lost += not rng.binomial(2 * alive, same).any()
    assert abs(N.missed(0.5, 2, 2) - lost / runs) < 0.01
    assert N.missed(1.0, 12, 8) == 0 and N.missed(0.8, 12, 8) > N.missed(0.8, 2, 8)


def test_links_at_the_threshold_in_a_large_family(docs_of):
    """Texts that all share much, so that nodes go deep, in pairs that are linked exactly at the threshold."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    passage, rows = [word() for _ in range(84)], []
    for k in range(250):
        tail = [word() for _ in range(4)]
        rows += [(2 * k + i, " ".join(passage + tail + [word() for _ in range(12)])) for i in range(2)]
    sets = {i: brute.shingles(t, 1) for i, t in rows}
    pairs = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 500, 2)]
    assert sum(0.78 <= x <= 0.80 for x in pairs) > 200
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs_of(rows), 1, 78, leaf=10).collect()}
    want = brute.groups(sets, brute.near_links(sets, 78))
    assert sum(got[i] != want[i] for i in want) <= 1
