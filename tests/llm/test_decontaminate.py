import itertools
import random

import numpy as np

from tests.llm import brute
from tracekit.llm import decontaminate as D


def tables():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdef", k=3))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((40, 25, 13, 9, 3, 60))]
    items += [(6, items[0][1]), (7, None), (8, ""), (9, "?!")]
    docs = []
    for i in range(120):
        body = [word() for _ in range(rng.randint(0, 50))]
        if i % 2:
            part = items[rng.randrange(6)][1].split()
            cut = rng.randint(0, max(0, len(part) - 14))
            part = part[cut:cut + rng.randint(10, 40)]
            for _ in range(rng.randint(0, 4)):
                part[rng.randrange(len(part))] = word()
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((i, rng.choice((" ", ", ", "\n")).join(body).upper() if i % 3 else " ".join(body)))
    docs += [(500, None), (501, ""), (None, items[1][1]), (3, docs[3][1]), (502, "zz " * 50_000 + items[5][1])]
    return items, docs


def test_equals_brute_force(docs_of, lspark):
    items, docs = tables()
    bench = lspark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, D.contaminated(docs_of(docs), bench).collect()), key=repr)
    want = []
    for i, text in docs:
        doc = brute.plain_words(text)
        if len(doc) > 5000:
            doc = doc[-200:]
        for k, item in items:
            item = brute.plain_words(item)
            n, equal = brute.best_overlap(doc, item, D.MAX_SUBSTITUTED) if item else (0, 0)
            if item and n >= min(D.MIN_WORDS, len(item)):
                want.append((i, k, n, equal))
    found = sorted(((r[0], r[1], r[3], r[4]) for r in got), key=repr)
    # a run that is found by another of its words may be shorter; three substitutions in few words may hide from all masks
    assert {x[:2] for x in found} <= {x[:2] for x in want}
    assert len(set(want) ^ set(found)) <= 0.04 * len(want) and len(want) > 40
    assert all(r[5] == r[4] / len(brute.plain_words(dict(items)[r[1]])) for r in got)


def test_blocks_and_filter_agree(docs_of, lspark):
    items, rows = tables()
    bench, docs = lspark.createDataFrame(items, "item_id long, text string"), docs_of(rows)
    whole = sorted(map(repr, D.contaminated(docs, bench).collect()))
    assert whole == sorted(map(repr, D.contaminated(docs, bench, block_words=20).collect()))
    left = D.drop_contaminated(docs, bench, block_words=60)
    assert left.columns == docs.columns
    hit = {r["doc_id"] for r in D.contaminated(docs, bench).collect()}
    assert sorted(repr(r["doc_id"]) for r in left.collect()) == sorted(repr(i) for i, _ in rows if i not in hit)


def test_any_two_substitutions_in_thirteen_words_share_a_seed():
    import itertools
    for gone in itertools.combinations(range(13), 2):
        assert any(all(at + o not in gone for o in D.offsets(m)) for m in D.MASKS for at in range(14 - len(m)))


def test_empty_tables(docs_of, lspark):
    none = lspark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs_of([]), none).collect() == []
    assert D.contaminated(docs_of([(1, "a b")]), none).collect() == []
    assert D.drop_contaminated(docs_of([(1, "a b")]), none).count() == 1


def test_every_allowed_pattern_shares_a_seed():
    # the least cost (4 a substituted word, -1 an equal one) of a pattern without a seed is positive, so more than a fifth is substituted
    span = max(map(len, D.MASKS))
    state = np.arange(1 << span)
    seeds = [sum(1 << (len(m) - 1 - o) for o in D.offsets(m)) for m in D.MASKS]
    hit = np.any([(state & s) == s for s in seeds], axis=0)
    cost = np.where(state == 0, 0, 10**6)
    least = []
    for _ in range(400):
        new = np.full(len(state), 10**6)
        for equal in (0, 1):
            np.minimum.at(new, (state << 1 | equal) & len(state) - 1, cost + (-1 if equal else 4))
        cost = np.where(hit, 10**6, new)
        least.append(cost.min())
    assert min(least[D.MIN_WORDS - 1:]) > 0
    assert min(least[300:]) > max(least[:100])  # grows with the length
    for n in range(1, D.MIN_WORDS):
        shapes = D.short_shapes(n, D.MAX_SUBSTITUTED)
        for gone in itertools.combinations(range(n), n // 5):
            assert any(not set(shape) & set(gone) for shape in shapes)


def test_all_allowed_substitutions_equal_brute_force(docs_of, lspark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(1, 26)]
    docs = [[word() for _ in range(rng.randint(0, 5))] + hide(rng, text.split()) + [word() for _ in range(rng.randint(0, 5))]
            for _, text in items for _ in range(20)]
    nine = items[8][1].split()
    docs += [["x", *nine[1:]], [*nine[:-1], "x"], nine[1:]]
    docs = [(i, " ".join(d)) for i, d in enumerate(docs)]
    want = []
    for i, text in docs:
        doc = brute.plain_words(text)
        for k, item in items:
            item = brute.plain_words(item)
            best = brute.best_overlap(doc, item, D.MAX_SUBSTITUTED)
            for at in range(len(doc) - len(item) + 1 if len(item) < D.MIN_WORDS else 0):
                equal = sum(a == b for a, b in zip(doc[at:], item))
                if equal and 5 * (len(item) - equal) <= len(item):
                    best = max(best, (len(item), equal))
            if best[0] >= min(D.MIN_WORDS, len(item)):
                want.append((i, k, *best))
    bench = lspark.createDataFrame(items, "item_id long, text string")
    got = [(r[0], r[1], r[3], r[4]) for r in D.contaminated(docs_of(docs), bench).collect()]
    assert sorted(got) == sorted(want) and len(want) > 400


def hide(rng, words):
    """As many words replaced as a whole item allows."""
    for at in rng.sample(range(len(words)), len(words) // 5):
        words[at] = "x"
    return words


def test_repetitive_texts_and_items():
    """Hits of a repetitive text and item are ranges, not all their pairs."""
    import time

    items = [(1, "la " * 160, 1), (2, "do re mi " * 30, 1), (3, "la " * 12, 2), (4, "la la la ti " * 20, 1)]
    texts = ["la " * 20_000, "do re mi " * 400 + "fa " + "do re mi " * 300, "la la la ti " * 2_000, "x " * 500 + "la " * 30]
    seeds = D.Seeds(items, D.MASKS, D.MAX_SUBSTITUTED)
    start = time.perf_counter()
    found = {(t, i): (at, n, same) for t, i, at, n, same, *_ in D._overlaps(seeds, texts[:1], D.MIN_WORDS, D.MAX_SUBSTITUTED)}
    assert time.perf_counter() - start < 8
    assert found[0, 1] == (0, 160, 160) and found[0, 3][1:] == (12, 12)
    hashes, first = D.batch_hashes(texts[1:], D.MARK)
    got = {tuple(h) for h in seeds.hits(hashes, first)}
    want = set()
    for shape, (places, lead) in [(D.offsets(m), (range(len(m)), 0)) for m in D.MASKS]:
        for t in range(3):
            doc = hashes[first[t]:first[t + 1]]
            a = D.window_hashes(doc, shape)
            for i, words in enumerate(seeds.words):
                if len(words) < 13:
                    continue
                b = D.window_hashes(words, shape)
                for x, key in enumerate(b.tolist()):
                    want |= {(t, i, int(y) - x) for y in np.flatnonzero(a == np.uint64(key))}
    assert {h for h in got if len(seeds.words[h[1]]) >= 13} == want


def test_equal_items_are_one_seed_and_a_row_each(docs_of, lspark):
    passage = " ".join(f"w{i}" for i in range(20))
    bench = lspark.createDataFrame([(1, passage)] * 3 + [(2, passage.replace(" ", "\n"))], "item_id long, text string")
    got = D.contaminated(docs_of([(7, "x " + passage), (8, "clean text")]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_words"]) for r in got) == [(7, 1, 20)] * 3 + [(7, 2, 20)]
    assert [len(s.ids) for s in D._blocks(bench, D.MASKS, 0.2, 1000)] == [2]
    assert sum(len(s.ids) for s in D._blocks(bench, D.MASKS, 0.2, 30)) == 2
