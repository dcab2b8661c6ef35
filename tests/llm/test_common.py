import random

import numpy as np

from tests.llm import brute
from tracekit.llm import _text
from tracekit.llm._common import components, local_components, ranked


def test_components_equal_union_find(lspark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r["id"]: r["root"] for r in components(lspark.createDataFrame(links, "a long, b long")).collect()}
    links = [(a, b) for a, b in links if a != b]
    assert got == brute.groups({x for link in links for x in link}, links)


def test_components_of_nothing(lspark):
    assert components(lspark.createDataFrame([], "a long, b long")).collect() == []


def test_local_components():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 200, 150), rng.integers(0, 200, 150)
    want = brute.groups(range(200), zip(a.tolist(), b.tolist()))
    assert local_components(200, a, b).tolist() == [want[i] for i in range(200)]


def test_ranked_is_the_global_position(lspark):
    rows = [(i % 7, i) for i in range(500)]
    got = ranked(lspark.createDataFrame(rows, "k long, v long").repartition(5), ["k", "v"]).collect()
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows)
    assert sorted(r["rank"] for r in got) == list(range(500))


def test_word_hashes_tell_words_apart():
    text = "Ab c\u00e9 \u2028x\x00 AB\tab\n\u6f22\u5b57 " * 3 + "y" * 300_000 + " ab"
    words = _text.space_words(text)
    assert words == brute.space_words(text)
    hashes = _text.word_hashes(_text.utf8(text)).tolist()
    assert len(hashes) == len(words)
    assert len({*zip(words, hashes)}) == len({*words}) == len({*hashes})


def test_batches_hash_like_single_texts():
    texts = [None, "", "a b", " ", "c\u00e9, d" * 70_000, "a"]
    hashes, first = _text.batch_hashes(texts, _text.MARK)
    for i, t in enumerate(texts):
        assert hashes[first[i]:first[i + 1]].tolist() == _text.word_hashes(_text.utf8(t), _text.MARK).tolist()
        assert [w.encode() for w in brute.plain_words(t)] == _text.plain_words(t)
